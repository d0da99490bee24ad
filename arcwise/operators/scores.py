"""PageRank with temporal weights, HITS, and graph colouring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from arcwise.operators.access import active, first_contacts
from arcwise.plans.session import Grown, discarded, kept_by, materialised

DAMPING = 0.85
ALPHA = 0.1
BUCKETS = 256
#: Steps between lineage cuts.
_CUT = 3
#: Arcs (16 bytes each) that one task may hold.
LOCAL_ARCS = 1_000_000


def page_rank(edges: DataFrame, ids: DataFrame, iterations: int, damping: float = DAMPING, alpha: float = ALPHA, normalize: bool = False, low: int | None = None, high: int | None = None) -> DataFrame:
    """(id, rank). Each pair's first contact passes on damping * (1 - exp(-alpha ts)) * rank / degree, where the degree counts all
    edges, also to nodes outside [low, high). Nodes without edges pass nothing on. ``normalize`` divides by the sum after each step.
    """
    n = ids.count()
    inside = edges if low is None else active(edges, low, high)
    degrees = edges.groupBy("src").agg(F.count("*").alias("degree"))
    weight = damping * (1 - F.exp(-alpha * F.col("ts"))) / F.col("degree")
    # Dealt out by source once: each step moves the ranks, not the arcs.
    arcs = kept_by(first_contacts(inside).join(degrees, "src").select("src", "dst", weight.alias("weight")), "src")
    ranks = ids.select("id", F.lit(1.0 / max(n, 1)).alias("rank"))
    for step in range(iterations):
        got = arcs.join(ranks, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("weight") * F.col("rank")).alias("got"))
        ranks = ids.join(got, F.col("id") == F.col("dst"), "left").select("id", (F.lit((1 - damping) / max(n, 1)) + F.coalesce("got", F.lit(0.0))).alias("rank"))
        if normalize:
            ranks = materialised(ranks, "ranks")
            total = ranks.agg(F.sum("rank").alias("total"))
            ranks = ranks.crossJoin(F.broadcast(total)).select("id", (F.col("rank") / F.col("total")).alias("rank"))  # one row
        elif step % _CUT == _CUT - 1 and step < iterations - 1:
            ranks = materialised(ranks, "ranks")
    ranks = materialised(ranks, "ranks")
    arcs.unpersist()
    return ranks


def rank_sum(ranks: DataFrame) -> DataFrame:
    """(total, ids): the sum of all ranks, and how many there are."""
    return ranks.agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("total"), F.count("*").alias("ids"))


def top_ranks(ranks: DataFrame, n: int = 10) -> DataFrame:
    """The n highest ranks; of equal ranks the least id."""
    return ranks.orderBy(F.desc("rank"), F.asc("id")).limit(n)


def _scaled(scores: DataFrame, column: str) -> DataFrame:
    scores = materialised(scores, column)
    norm = scores.agg(F.sqrt(F.sum(F.col(column) * F.col(column))).alias("norm"))
    return scores.crossJoin(F.broadcast(norm)).select("id", F.when(F.col("norm") > 0, F.col(column) / F.col("norm")).otherwise(F.col(column)).alias(column))  # one row


def hits(edges: DataFrame, ids: DataFrame, iterations: int) -> DataFrame:
    """(id, hub, authority), both of length one after each half step; each pair counts once."""
    # Each half step joins on the other end: pairs are dealt out both ways once.
    by = {key: kept_by(edges.select("src", "dst").distinct(), key) for key in ("src", "dst")}
    hub = ids.select("id", F.lit(1.0).alias("hub"))
    authority = ids.select("id", F.lit(1.0).alias("authority"))

    def passed(scores, score, at, to, name):
        got = by[at].join(scores.withColumnRenamed("id", at), at).groupBy(F.col(to).alias("id")).agg(F.sum(score).alias("got"))
        return _scaled(ids.join(got, "id", "left").select("id", F.coalesce("got", F.lit(0.0)).alias(name)), name)

    for _ in range(iterations):
        hub = passed(authority, "authority", "dst", "src", "hub")
        authority = passed(hub, "hub", "src", "dst", "authority")
    out = materialised(hub.join(authority, "id"), "scores")
    for pairs in by.values():
        pairs.unpersist()
    return out


def hash_priority(id_: str = "id") -> Column:
    """Top byte of id * 2654435761 modulo 2**32."""
    return F.shiftright((F.col(id_) * 2_654_435_761) % 4_294_967_296, 24).cast("bigint")


def sequence_priorities(spark: SparkSession, n: int, seed: int = 123, block: int = 4_096) -> DataFrame:
    """(id, priority) for ids 0..n-1: the top byte of the 48-bit linear congruential sequence that the Java platform documents.

    A block's first state follows from its index by squaring the step, so blocks are made in parallel.
    """
    mult, add, mask = 0x5DEECE66D, 0xB, (1 << 48) - 1
    first = (seed ^ mult) & mask

    def jumped(k: int) -> int:
        a, c, m, b = 1, 0, mult, add
        while k:
            if k & 1:
                a, c = a * m & mask, (c * m + b) & mask
            m, b = m * m & mask, (b * m + b) & mask
            k >>= 1
        return (first * a + c) & mask

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start in batch.column("id").to_pylist():
                state, out = jumped(start * block), []
                for _ in range(min(block, n - start * block)):
                    state = (state * mult + add) & mask
                    out.append(state >> 40)
                yield pa.RecordBatch.from_arrays([pa.array(range(start * block, start * block + len(out)), pa.int64()), pa.array(out, pa.int64())], names=["id", "priority"])

    return spark.range(-(-n // block)).mapInArrow(run, "id bigint, priority bigint")


def _layers(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, layer) of the ends of arcs without cycles: 0 where none begins, else one more than the highest layer that arcs lead to."""
    ids, place = np.unique(np.concatenate([src, dst]), return_inverse=True)
    s, d = place[: len(src)], place[len(src) :]
    order = np.argsort(d, kind="stable")
    s, begin = s[order], np.searchsorted(d[order], np.arange(len(ids) + 1))
    waits = np.bincount(s, minlength=len(ids))
    layer = np.zeros(len(ids), np.int64)
    ready, c = np.flatnonzero(waits == 0), 0
    while len(ready):
        layer[ready] = c
        many = begin[ready + 1] - begin[ready]
        freed = s[np.repeat(begin[ready] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        np.subtract.at(waits, freed, 1)
        freed = np.unique(freed)
        ready, c = freed[waits[freed] == 0], c + 1
    return ids, layer


def color(edges: DataFrame, priorities: DataFrame, max_rounds: int = 512, local_arcs: int = LOCAL_ARCS) -> DataFrame:
    """(id, color): 0 if no out-neighbour has a higher priority (or an equal one and a lesser id), else one more than their highest color.

    A node takes color c in round c once all such neighbours have one below c. Nodes left after max_rounds have null.
    A round writes only the arcs that are left and the nodes it colors; when ``local_arcs`` arcs or fewer are left, one task does the rest.
    """
    spark = edges.sparkSession
    p = materialised(priorities.select("id", "priority"), "priorities")
    arcs = edges.select("src", "dst").filter("src != dst").distinct()
    named = arcs.join(p.select(F.col("id").alias("src"), F.col("priority").alias("own")), "src").join(p.select(F.col("id").alias("dst"), F.col("priority").alias("other")), "dst")
    above = materialised(named.filter("other > own or (other = own and dst < src)").select("src", "dst"), "above")
    done = Grown(spark, "id bigint, color bigint", "colors")
    begins = lambda arcs: arcs.select(F.col("src").alias("id")).distinct()
    now = done.add(p.select("id").join(begins(above), "id", "left_anti").filter(F.lit(max_rounds > 0)).select("id", F.lit(0).cast("bigint").alias("color")))
    c = 0
    while (left := above.count()) > local_arcs and c + 1 < max_rounds:
        # Arcs lead to nodes without color, or to those of the round before: the latter go.
        c += 1
        step = materialised(above.join(now.select(F.col("id").alias("dst"), F.lit(True).alias("gone")), "dst", "left").select("src", "dst", F.coalesce("gone", F.lit(False)).alias("gone")), "above")
        discarded(above)
        above = step.filter("not gone").select("src", "dst")
        above._table_path = step._table_path
        now = done.add(begins(step.filter("gone")).join(begins(above), "id", "left_anti").select("id", F.lit(c).cast("bigint").alias("color")))
    if 0 < left <= local_arcs:

        def rest(batches):
            import pyarrow as pa

            t = pa.Table.from_batches(batches)
            ids, layer = _layers(t.column("src").to_numpy(), t.column("dst").to_numpy())
            some = (layer > 0) & (layer + c < max_rounds)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(layer[some] + c)], names=["id", "color"])

        done.add(above.repartition(1).mapInArrow(rest, done.schema))
    return p.select("id").join(done.rows, "id", "left")
