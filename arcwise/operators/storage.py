"""Storage analysis: gaps, runs, intervals, residuals, code lengths, and the parameter sweep."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from arcwise.functions import codec
from arcwise.plans.session import discarded, kept_by, materialised

MIN_INTERVAL = 4
#: The sweep's shrinking factors and time buckets in seconds.
SWEEP_K = (2, 3, 4, 5, 6, 7)
SWEEP_FACTORS = (1, 60, 900, 1_800, 3_600, 14_400, 86_400, 172_800)
#: Bits of the least time before a time stream.
HEADER_BITS = 64
#: Lists before a source's that it may refer to.
WINDOW = 7


def _order():
    return Window.partitionBy("src").orderBy("dst", "ts")


def min_time(edges: DataFrame) -> DataFrame:
    return edges.agg(F.min("ts").alias("min_ts"))


def encode_times(edges: DataFrame, factor: int = 1) -> DataFrame:
    """(src, nth, dst, delta): zig-zag differences of bucketed times in list order, the first against the graph's least."""
    low = edges.agg(codec.bucket_index(F.min("ts"), factor).alias("_low"))
    e = edges.withColumn("_b", codec.bucket_index("ts", factor)).crossJoin(F.broadcast(low))  # one row
    before = F.coalesce(F.lag("_b").over(_order()), F.col("_low"))
    return e.select("src", (F.row_number().over(_order()).cast("bigint") - 1).alias("nth"), "dst", codec.int2nat(F.col("_b") - before).alias("delta"))


def decode_times(encoded: DataFrame, min_ts: int, factor: int = 1) -> DataFrame:
    """(src, nth, dst, ts) of encoded times: running sums."""
    run = Window.partitionBy("src").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    low = F.call_function("div", F.lit(min_ts).cast("bigint"), F.lit(factor).cast("bigint"))
    return encoded.select("src", "nth", "dst", ((F.sum(codec.nat2int("delta")).over(run) + low) * factor).alias("ts"))


def multiples(edges: DataFrame, least: int = 2) -> DataFrame:
    """(src, dst, len): runs of parallel edges."""
    return edges.groupBy("src", "dst").agg(F.count("*").alias("len")).filter(F.col("len") >= least)


def _singles(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n")).filter("n = 1").select("src", "dst")


def _islands(edges: DataFrame) -> DataFrame:
    """Singles with the island of consecutive ids that they stand in, and its size."""
    w = Window.partitionBy("src").orderBy("dst")
    s = _singles(edges).withColumn("island", F.col("dst") - F.row_number().over(w))
    return s.withColumn("len", F.count("*").over(Window.partitionBy("src", "island")))


def intervals(edges: DataFrame, least: int = MIN_INTERVAL) -> DataFrame:
    """(src, start, len): maximal runs of consecutive neighbours that occur once."""
    return _islands(edges).groupBy("src", "island").agg(F.min("dst").alias("start"), F.count("*").alias("len")).filter(F.col("len") >= least).select("src", "start", "len")


def residuals(edges: DataFrame, least: int = MIN_INTERVAL) -> DataFrame:
    """(src, dst, gap): what is in neither multiples nor intervals; gaps are zig-zag against the source, then less one."""
    before = F.lag("dst").over(Window.partitionBy("src").orderBy("dst"))
    rest = _islands(edges).filter(F.col("len") < least).withColumn("before", before)
    return rest.select("src", "dst", F.when(F.col("before").isNull(), codec.int2nat(F.col("dst") - F.col("src"))).otherwise(F.col("dst") - F.col("before") - 1).alias("gap"))


def multiple_gaps(edges: DataFrame, least: int = 2) -> DataFrame:
    """(src, dst, gap, extra): start gaps and lengths less the least one."""
    before = F.lag("dst").over(Window.partitionBy("src").orderBy("dst"))
    m = multiples(edges, least).withColumn("before", before)
    return m.select("src", "dst", F.when(F.col("before").isNull(), codec.int2nat(F.col("dst") - F.col("src"))).otherwise(F.col("dst") - F.col("before") - 1).alias("gap"), (F.col("len") - least).alias("extra"))


def interval_gaps(edges: DataFrame, least: int = MIN_INTERVAL) -> DataFrame:
    """(src, start, gap, extra): gaps from the end of the interval before, and lengths less the least one."""
    w = Window.partitionBy("src").orderBy("start")
    i = intervals(edges, least).withColumn("before", F.lag(F.col("start") + F.col("len")).over(w))
    return i.select("src", "start", F.when(F.col("before").isNull(), codec.int2nat(F.col("start") - F.col("src"))).otherwise(F.col("start") - F.col("before") - 1).alias("gap"), (F.col("len") - least).alias("extra"))


def expand_multiples(runs: DataFrame) -> DataFrame:
    """(src, dst): each run's id as often as it is long."""
    return runs.select("src", F.explode(F.array_repeat("dst", F.col("len").cast("int"))).alias("dst"))


def expand_intervals(runs: DataFrame) -> DataFrame:
    return runs.select("src", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("dst"))


def merged(edges: DataFrame, least: int = MIN_INTERVAL) -> DataFrame:
    """(src, nth, dst): the lists put together again from multiples, intervals and residuals, in order."""
    parts = expand_multiples(multiples(edges)).unionByName(expand_intervals(intervals(edges, least))).unionByName(residuals(edges, least).select("src", "dst"))
    return parts.select("src", (F.row_number().over(Window.partitionBy("src").orderBy("dst")).cast("bigint") - 1).alias("nth"), "dst")


def _by_logarithm(gaps: DataFrame) -> DataFrame:
    bin_ = F.when(F.col("gap") > 0, codec.log2_floor(F.greatest("gap", F.lit(1)))).otherwise(-1)
    return gaps.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.sum("gap").alias("total"))


def residual_histogram(edges: DataFrame, least: int = MIN_INTERVAL) -> DataFrame:
    """(bin, n, total): the gaps of residuals by binary logarithm. Bin -1: zero gaps."""
    return _by_logarithm(residuals(edges, least))


def gap_histogram(edges: DataFrame) -> DataFrame:
    """(bin, n, total): positive gaps between distinct neighbours by binary logarithm; the first gap is zig-zag against the source. Bin -1: zero gaps."""
    pairs = edges.select("src", "dst").distinct()
    before = F.lag("dst").over(Window.partitionBy("src").orderBy("dst"))
    gaps = pairs.withColumn("before", before).select(F.when(F.col("before").isNull(), codec.int2nat(F.col("dst") - F.col("src"))).otherwise(F.col("dst") - F.col("before")).alias("gap"))
    return _by_logarithm(gaps)


def reference_bits(edges: DataFrame, window: int = WINDOW, k: int = 3) -> DataFrame:
    """(src, ref, copied, extra, bits) of each source's distinct neighbours against the list of ``src - ref``, for ref 0 (none) to window where that has a list.

    Bits: unary ref; behind a reference gamma codes of the runs of its list that are copied and skipped in turn, but the last
    (their number, the first length, then lengths less one; a copied run comes first, empty if need be); zeta codes of the
    gaps of what isn't copied. Lists are joined by source and id, so no task holds more than runs of one list.
    """
    own = edges.select("src", "dst").distinct()
    refs = F.explode(F.sequence(F.lit(1), F.lit(window))).alias("ref")
    other = own.select("src", "dst", refs).select((F.col("src") + F.col("ref")).alias("src"), F.col("ref").cast("bigint").alias("ref"), "dst")
    # Only sources that have a list of their own refer to others.
    has = other.join(own.select("src").distinct(), "src", "left_semi")
    marked = has.join(own.withColumn("hit", F.lit(True)), ["src", "dst"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    in_list = Window.partitionBy("src", "ref").orderBy("dst")
    turn = (F.col("hit") != F.coalesce(F.lag("hit").over(in_list), F.lit(True))).cast("bigint")
    runs = marked.withColumn("turn", turn).withColumn("run", F.sum("turn").over(in_list)).groupBy("src", "ref", "run").agg(F.count("*").alias("len"), F.max("hit").alias("hit"))
    last = F.max("run").over(Window.partitionBy("src", "ref"))
    runs = runs.withColumn("last", last)
    # Run 0 is the copied one; where the list begins with a skipped run it is empty.
    size = F.when(F.col("run") == 0, codec.gamma_bits("len")).otherwise(codec.gamma_bits(F.col("len") - 1))
    blocks = runs.groupBy("src", "ref").agg(F.sum(F.when(F.col("hit"), F.col("len")).otherwise(0)).alias("copied"), F.max("last").alias("written"), F.min("run").alias("first"), F.sum(F.when(F.col("run") < F.col("last"), size).otherwise(0)).alias("size"))
    blocks = blocks.select("src", "ref", "copied", (codec.gamma_bits("written") + F.col("size") + F.when((F.col("first") > 0), codec.gamma_bits(F.lit(0).cast("bigint"))).otherwise(0)).alias("block_bits"))
    every = blocks.select("src", "ref").unionByName(own.select("src", F.lit(0).cast("bigint").alias("ref")).distinct())
    hits = marked.filter("hit").select("src", "ref", "dst")
    extra = own.join(every, "src").join(hits, ["src", "ref", "dst"], "left_anti")
    before = F.lag("dst").over(in_list)
    gap = F.when(F.col("before").isNull(), codec.int2nat(F.col("dst") - F.col("src"))).otherwise(F.col("dst") - F.col("before") - 1)
    extra = extra.withColumn("before", before).groupBy("src", "ref").agg(F.count("*").alias("extra"), F.sum(codec.zeta_bits(gap, k)).alias("extra_bits"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    out = every.join(blocks, ["src", "ref"], "left").join(extra, ["src", "ref"], "left")
    return out.select("src", "ref", none("copied").alias("copied"), none("extra").alias("extra"), (codec.unary_bits("ref") + none("block_bits") + none("extra_bits")).alias("bits"))


def best_references(edges: DataFrame, window: int = WINDOW, k: int = 3) -> DataFrame:
    """(src, ref, copied, extra, bits): for each source the reference of least bits; of equal ones the least."""
    best = F.min_by(F.struct("ref", "copied", "extra", "bits"), F.struct("bits", "ref")).alias("b")
    return reference_bits(edges, window, k).groupBy("src").agg(best).select("src", "b.ref", "b.copied", "b.extra", "b.bits")


def reference_depths(best: DataFrame) -> DataFrame:
    """(depth, n): how many sources end chains of so many references. Chains are followed by doubling, in about as many steps as the depth has bits."""
    now = materialised(best.select(F.col("src").alias("id"), F.when(F.col("ref") > 0, F.col("src") - F.col("ref")).alias("to"), (F.col("ref") > 0).cast("bigint").alias("depth")), "chains")
    while not now.filter("to is not null").isEmpty():
        far = now.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"))
        last, now = now, materialised(now.join(far, "to", "left").select("id", F.col("next").alias("to"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "chains")
        discarded(last)
    return now.groupBy("depth").agg(F.count("*").alias("n"))


def node_bits(edges: DataFrame, k_times: int = 2, k_residuals: int = 3) -> DataFrame:
    """(src, arcs, time_bits, multiple_bits, interval_bits, residual_bits) of each source's list, without references to other lists."""
    # Dealt out by source once: windows, groups and joins below all go by source or by pairs of one.
    edges = kept_by(edges.select("src", "dst", "ts"), "src")
    times = encode_times(edges).groupBy("src").agg(F.count("*").alias("arcs"), F.sum(codec.zeta_bits("delta", k_times)).alias("time_bits"))
    m = multiple_gaps(edges).groupBy("src").agg(F.count("*").alias("mc"), F.sum(codec.gamma_bits("gap") + codec.gamma_bits("extra")).alias("mb"))
    i = interval_gaps(edges).groupBy("src").agg(F.count("*").alias("ic"), F.sum(codec.gamma_bits("gap") + codec.gamma_bits("extra")).alias("ib"))
    r = residuals(edges).groupBy("src").agg(F.sum(codec.zeta_bits("gap", k_residuals)).alias("rb"))
    out = times.join(m, "src", "left").join(i, "src", "left").join(r, "src", "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    out = out.select("src", "arcs", "time_bits", (codec.gamma_bits(none("mc")) + none("mb")).alias("multiple_bits"), (codec.gamma_bits(none("ic")) + none("ib")).alias("interval_bits"), none("rb").alias("residual_bits"))
    out = materialised(out, "bits")
    edges.unpersist()
    return out


def offsets(edges: DataFrame) -> DataFrame:
    """(src, bits, offset): where each source's times start, as a running sum of code lengths behind the header.

    Sums are made within blocks of ids; only the blocks' totals go through one task.
    """
    bits = encode_times(edges).groupBy("src").agg(F.sum(codec.zeta_bits("delta", 2)).alias("bits")).withColumn("block", F.floor(F.col("src") / 65_536))
    totals = bits.groupBy("block").agg(F.sum("bits").alias("t")).withColumn("base", F.coalesce(F.sum("t").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("block", "base")
    within = F.coalesce(F.sum("bits").over(Window.partitionBy("block").orderBy("src").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return bits.withColumn("within", within).join(totals, "block").select("src", "bits", (F.col("within") + F.col("base") + HEADER_BITS).alias("offset"))


def sweep(edges: DataFrame, ks=SWEEP_K, factors=SWEEP_FACTORS) -> DataFrame:
    """(k, factor, time_bits, index_bits) for every combination, in one pass: edges are sorted once, and each row carries all factors' deltas."""
    low = edges.agg(F.min("ts").alias("_low"))
    e = edges.select("src", "dst", "ts").crossJoin(F.broadcast(low)).withColumn("_before", F.coalesce(F.lag("ts").over(_order()), F.col("_low")))  # one row
    lit = lambda f: F.lit(f).cast("bigint")
    deltas = F.array(*[F.struct(lit(f).alias("factor"), codec.int2nat(codec.bucket_difference("_before", "ts", lit(f))).alias("delta")) for f in factors])
    rows = e.select("src", F.explode(deltas).alias("x")).select("src", "x.factor", "x.delta")
    per = rows.groupBy("factor").agg(F.countDistinct("src").alias("nodes"), *[F.sum(codec.zeta_bits("delta", k)).alias(f"k{k}") for k in ks])
    out = per.select("factor", "nodes", F.explode(F.array(*[F.struct(lit(k).alias("k"), (F.col(f"k{k}") + HEADER_BITS).alias("time_bits")) for k in ks])).alias("x"))
    return out.select("x.k", "factor", "x.time_bits", codec.elias_fano_bits("nodes", "x.time_bits").alias("index_bits"))


def properties(edges: DataFrame, nodes: int) -> DataFrame:
    """One row: nodes, arcs, bits, bits per link and node, bits of each part per node, and the ratio to the information-theoretic bound (null if there are as many arcs as pairs of nodes)."""
    b = node_bits(edges).agg(F.sum("arcs").alias("arcs"), F.sum("time_bits").alias("time_bits"), F.sum(F.col("multiple_bits") + F.col("interval_bits") + F.col("residual_bits")).alias("graph_bits"), *[F.round(F.sum(f"{part}_bits") / nodes, 6).alias(f"avg_{part}_bits") for part in ("multiple", "interval", "residual")])
    n2 = float(nodes) * nodes

    def stirling(x):
        return x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x)

    arcs = F.col("arcs").cast("double")
    bound = (stirling(F.lit(n2)) - stirling(arcs) - stirling(F.lit(n2) - arcs)) / math.log(2)
    return b.select(F.lit(nodes).cast("bigint").alias("nodes"), "arcs", "graph_bits", "time_bits", F.round(F.col("graph_bits") / arcs, 6).alias("bits_per_link"), F.round(F.col("graph_bits") / nodes, 6).alias("bits_per_node"), "avg_multiple_bits", "avg_interval_bits", "avg_residual_bits", F.when(F.lit(n2) > arcs, F.round(F.col("graph_bits") / bound, 6)).alias("ratio"))
