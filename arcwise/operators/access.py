"""Neighbour access, predicates and projections on edges (src, dst, ts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from arcwise.plans.session import materialised

#: Contacts of a node that may stand in one row.
HUB = 1_000_000


def vertices(spark: SparkSession, low: int, high: int) -> DataFrame:
    """Ids low..high-1."""
    return spark.range(low, high).select(F.col("id"))


def active(edges: DataFrame, low: int, high: int) -> DataFrame:
    """Edges with both ends in [low, high)."""
    inside = lambda c: (F.col(c) >= low) & (F.col(c) < high)
    return edges.filter(inside("src") & inside("dst"))


def first_contacts(edges: DataFrame) -> DataFrame:
    """Each pair once, with its least time."""
    return edges.groupBy("src", "dst").agg(F.min("ts").alias("ts"))


def successors(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(src, nth, dst, ts): the neighbours of all nodes, or of the given ids, in order of (dst, ts), from 0."""
    e = edges if ids is None else edges.join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    return e.withColumn("nth", F.row_number().over(Window.partitionBy("src").orderBy("dst", "ts")).cast("bigint") - 1).select("src", "nth", "dst", "ts")


def skipped(edges: DataFrame, n: int) -> DataFrame:
    """Successors without the first n of each node."""
    return successors(edges).filter(F.col("nth") >= n)


def adjacency(edges: DataFrame) -> DataFrame:
    """Neighbours without times; times aren't read."""
    return edges.select("src", "dst")


def out_degrees(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, degree): parallel edges count; ids without edges have 0."""
    return ids.join(edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")), "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def are_neighbors(pairs: DataFrame, edges: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """pairs (u, v) with ``linked``: whether an edge leads from u to v, with a time in [low, high] if these are given."""
    e = edges if low is None else edges.filter(F.col("ts").between(low, high))
    # Only asked pairs are aggregated: the semi join comes first.
    asked = pairs.select(F.col("u").alias("src"), F.col("v").alias("dst")).distinct()
    there = e.join(asked, ["src", "dst"], "left_semi").select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct().withColumn("_there", F.lit(True))
    return pairs.join(there, ["u", "v"], "left").select("u", "v", F.coalesce("_there", F.lit(False)).alias("linked"))


def scan_digest(edges: DataFrame) -> DataFrame:
    """One row for each source: what a full scan of its list reads."""
    return edges.groupBy("src").agg(F.count("*").alias("n"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.sum("dst").alias("sum_dst"))


def hashed_probes(spark: SparkSession, n: int, low: int, high: int, seed: int = 12_345) -> DataFrame:
    """n probes (probe, id) spread over [low, high), with repetitions, the same on every run."""
    mixed = ((F.col("id") + seed) * 2_654_435_761) % 4_294_967_296
    return spark.range(n).select(F.col("id").alias("probe"), (low + mixed % (high - low)).alias("id"))


def random_access(probes: DataFrame, edges: DataFrame) -> DataFrame:
    """The digest of each probed node's list; repeated probes give repeated rows, nodes without edges 0 rows read."""
    ids = probes.select("id").distinct()
    read = scan_digest(edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")).withColumnRenamed("src", "id")
    return probes.join(read, "id", "left").select("probe", "id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "min_ts", "max_ts", "sum_dst")


def low_degree(degrees: DataFrame, below: int = 4) -> DataFrame:
    return degrees.select("id", (F.col("degree") < below).alias("low"))


def seed_counts(degrees: DataFrame, above: int = 9) -> DataFrame:
    """How many nodes have more edges than ``above``, and how many don't."""
    many = F.col("degree") > above
    return degrees.agg(F.count_if(many).alias("seeds"), F.count_if(~many).alias("others"))


def copied_arcs(edges: DataFrame, ref: int) -> DataFrame:
    """For each source, how many of its distinct neighbours the list of ``src - ref`` has too, and how many not."""
    own = edges.select("src", "dst").distinct()
    other = own.select((F.col("src") + ref).alias("src"), "dst", F.lit(1).alias("hit"))
    return own.join(other, ["src", "dst"], "left").groupBy("src").agg(F.count("hit").alias("copied"), F.count_if(F.col("hit").isNull()).alias("extra"))


def degree_summary(degrees: DataFrame) -> DataFrame:
    """Sum, mean, maximum and the least id that has it."""
    return degrees.agg(F.sum("degree").alias("total"), F.avg("degree").alias("mean"), F.max("degree").alias("most"), F.min_by("id", F.struct(-F.col("degree"), F.col("id"))).alias("at"))


def _folded(e: DataFrame) -> DataFrame:
    """(id, n, mean_ts): truncating running means, of lists that fit into a row."""
    times = F.transform(F.array_sort(F.collect_list(F.struct("dst", "ts"))), lambda x: x["ts"])
    by = e.groupBy(F.col("src").alias("id")).agg(times.alias("times"))
    zero = F.lit(0).cast("bigint")
    step = lambda s, t: F.struct((s["k"] + 1).alias("k"), (s["m"] + F.call_function("div", t - s["m"], s["k"] + 1)).alias("m"))
    return by.select("id", F.size("times").cast("bigint").alias("n"), F.aggregate("times", F.struct(zero.alias("k"), zero.alias("m")), step)["m"].alias("mean_ts"))


def _streamed(e: DataFrame) -> DataFrame:
    """The same of lists of any length: sorted by Spark, which spills, and read once."""

    def run(batches):
        import pyarrow as pa

        now, n, m, out = None, 0, 0, []
        for batch in batches:
            for src, t in zip(batch.column("src").to_pylist(), batch.column("ts").to_pylist(), strict=True):
                if src != now:
                    if now is not None:
                        out.append((now, n, m))
                    now, n, m = src, 0, 0
                n += 1
                apart = t - m
                m += apart // n if apart >= 0 else -(-apart // n)
        if now is not None:
            out.append((now, n, m))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["id", "n", "mean_ts"])

    return e.select("src", "dst", "ts").repartition("src").sortWithinPartitions("src", "dst", "ts").mapInArrow(run, "id bigint, n bigint, mean_ts bigint")


def degree_centrality(edges: DataFrame, ids: DataFrame, start: int = 0, end: int = 0, mean: str = "integer", hub: int = HUB) -> DataFrame:
    """(id, degree, mean_ts): contacts in the closed window (0, 0: none), weighted by how late they are.

    ``mean``: "integer" takes the truncating running mean in order of (dst, ts), "exact" the plain average. The former depends
    on the order, so a node's contacts are read one after the other: as a row up to ``hub`` of them, else as a sorted stream. With a
    window the degree becomes trunc(0.85 n + 0.15 n (mean - start) / (end - start) + 1), also for nodes without contacts.
    """
    e = edges if start == end == 0 else edges.filter(F.col("ts").between(start, end))
    if mean == "integer":
        many = materialised(e.groupBy("src").agg(F.count("*").alias("n")).filter(F.col("n") > hub).select("src"), "hubs")
        if many.isEmpty():
            by = _folded(e)
        else:
            by = _folded(e.join(many, "src", "left_anti")).unionByName(_streamed(e.join(many, "src", "left_semi")))
    else:
        by = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.avg("ts").alias("mean_ts"))
    out = ids.join(by, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.coalesce("mean_ts", F.lit(0)).alias("mean_ts"))
    degree = F.col("n")
    if start != end:
        degree = (0.85 * F.col("n") + 0.15 * F.col("n") * (F.col("mean_ts") - start) / (end - start) + 1).cast("bigint")
    return out.select("id", degree.alias("degree"), "mean_ts")
