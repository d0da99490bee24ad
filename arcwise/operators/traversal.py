"""Breadth-first search, earliest arrival, reachability and components as loops of DataFrame steps.

Each step joins a frontier with the edges, reduces what it touches, and appends its new rows to the state, which is never
written again. Edges are pre-reduced where the semantics allow it and stay dealt out by source, so that a step moves its
frontier only. The driver holds only whether a frontier is empty, and how many contacts slices of time have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from arcwise.operators.access import first_contacts
from arcwise.plans.session import Grown, discarded, kept_by, materialised, numbered

#: Contacts that one task takes in order of time.
LOCAL_CONTACTS = 1_000_000


def bfs(edges: DataFrame, start: int, parents: bool = True) -> DataFrame:
    """(id, dist, parent, ts): first touch in queue order; ts is the time of that pair's first contact. The start has parent -1 and ts 0.

    Without ``parents`` (id, dist): no order is kept. Steps are as many as the largest distance.
    """
    spark = edges.sparkSession
    contacts = kept_by(first_contacts(edges) if parents else edges.select("src", "dst").distinct(), "src")
    done = Grown(spark, "id bigint, dist bigint, parent bigint, ts bigint, place bigint" if parents else "id bigint, dist bigint", "seen")
    frontier = done.add(spark.createDataFrame([(start, 0, -1, 0, 0) if parents else (start, 0)], done.schema))
    dist = 0
    while not frontier.isEmpty():
        dist += 1
        touched = contacts.join(frontier.select(F.col("id").alias("src"), *([F.col("place").alias("_from")] if parents else [])), "src")
        by = touched.groupBy(F.col("dst").alias("id"))
        best = (by.agg(F.min(F.struct("_from", "src", "ts")).alias("b")) if parents else by.agg(F.lit(dist).cast("bigint").alias("dist"))).join(done.rows.select("id"), "id", "left_anti")
        if parents:
            best = materialised(best.select("id", F.lit(dist).cast("bigint").alias("dist"), F.col("b.src").alias("parent"), F.col("b.ts").alias("ts"), F.col("b._from").alias("_from")), "level")
            frontier = done.add(numbered(best, ["_from", "id"], "place").select("id", "dist", "parent", "ts", F.col("place").cast("bigint")))
            discarded(best)
        else:
            frontier = done.add(best)
    contacts.unpersist()
    return done.rows.drop("place")


def _in_order(src: list, dst: list, ts: list, reached: set) -> dict:
    """The ids that contacts (in order of time) reach besides those reached before, each with its time; contacts at one time may follow one another."""
    new = {}
    i = 0
    while i < len(ts):
        now, links, begins = ts[i], {}, i
        while i < len(ts) and ts[i] == now:
            i += 1
        for k in range(begins, i):
            if dst[k] not in reached:
                links.setdefault(src[k], []).append(dst[k])
        front = [x for x in links if x in reached]
        for x in front:
            for y in links[x]:
                if y not in reached:
                    reached.add(y)
                    new[y] = now
                    if y in links:
                        front.append(y)
    return new


def _by_slices(contacts: DataFrame, local: int) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """(the contacts with a number ``part`` that grows with time, slices of parts (first, last, rows) in order of time).

    Contacts at one time stand in one part. A slice has ``local`` contacts at most unless it is one part.
    """
    n = contacts.count()
    if not n:
        return contacts, []
    parts = materialised(contacts.select("src", "dst", "ts").repartitionByRange(max(1, -(-4 * n // local)), "ts").withColumn("part", F.spark_partition_id()), "slices", 0, "part")
    slices: list[tuple[int, int, int]] = []
    for r in parts.groupBy("part").count().orderBy("part").collect():  # a row for local / 4 contacts
        if slices and slices[-1][2] + r["count"] <= local:
            slices[-1] = slices[-1][0], r["part"], slices[-1][2] + r["count"]
        else:
            slices.append((r["part"], r["part"], r["count"]))
    return parts, slices


def _step_by_step(contacts: DataFrame, times: Grown) -> None:
    """Adds to times what contacts improve, by steps that take one contact of each path."""
    e = kept_by(contacts, "src")
    best = lambda: times.rows.groupBy("id").agg(F.min("ts").alias("ts"))
    frontier = best()
    while not frontier.isEmpty():
        offers = e.join(frontier.select(F.col("id").alias("src"), F.col("ts").alias("since")), "src").filter("since <= ts").groupBy(F.col("dst").alias("id")).agg(F.min("ts").alias("new"))
        frontier = times.add(offers.join(best(), "id", "left").filter("ts is null or new < ts").select("id", F.col("new").alias("ts")))
    e.unpersist()


def earliest_arrival(edges: DataFrame, starts: DataFrame, contacts: str = "first", parents: bool = False, local: int = LOCAL_CONTACTS) -> DataFrame:
    """(id, ts): least time at which time-respecting paths from the start ids (id), at time 0, arrive.

    ``contacts``: "first" lets only the first contact of each pair be taken, "all" any of them. ``parents`` adds (parent): the
    least id from which such a path takes its last contact at that time, -1 for starts.

    Contacts are taken in slices of time, earliest first, so an id's first time is its least. A slice has ``local`` contacts at most, which one task
    takes in order; contacts to ids that are reached already go, from all slices left after the 1st, 3rd, 7th ... of them. Thus there are as many
    steps as slices, however long paths are. More contacts than that at one time are taken step by step.
    """
    spark = edges.sparkSession
    e = materialised((first_contacts(edges) if contacts == "first" else edges.select("src", "dst", "ts").distinct()).filter("src is not null"), "contacts")
    times = Grown(spark, "id bigint, ts bigint", "times")
    times.add(starts.select("id", F.lit(0).cast("bigint").alias("ts")).distinct())
    known = lambda side: times.rows.select(F.col("id").alias(side)).distinct()
    useful = lambda rows: rows.join(known("dst"), "dst", "left_anti").select("src", "dst", "ts")

    def ordered(batches):
        import pyarrow as pa

        rows = [batch.select(["src", "dst", "ts", "known"]).to_pydict() for batch in batches]
        src, dst, ts, seen = ([x for r in rows for x in r[c]] for c in ("src", "dst", "ts", "known"))
        new = _in_order(src, dst, ts, {x for x, is_known in zip(src, seen, strict=True) if is_known})
        yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.int64()), pa.array(list(new.values()), pa.int64())], names=["id", "ts"])

    rest = materialised(useful(e.filter("ts >= 0")), "contacts")
    many = 1
    while True:
        parts, slices = _by_slices(rest, local)
        discarded(rest)
        for low, high, rows in slices[:many]:
            own = useful(parts.filter(F.col("part").between(low, high)))
            if rows > local:
                _step_by_step(own, times)
            else:
                marked = own.join(known("src").withColumn("known", F.lit(True)), "src", "left").select("src", "dst", "ts", F.coalesce("known", F.lit(False)).alias("known"))
                times.add(marked.repartition(1).sortWithinPartitions("ts").mapInArrow(ordered, times.schema))
        if len(slices) <= many:
            discarded(parts)
            break
        rest = materialised(useful(parts.filter(F.col("part") > slices[many - 1][1])), "contacts")
        discarded(parts)
        many *= 2
    out = materialised(times.rows.groupBy("id").agg(F.min("ts").alias("ts")), "arrival")
    if parents:
        last = e.join(out.select(F.col("id").alias("src"), F.col("ts").alias("since")), "src").filter("since <= ts").groupBy(F.col("dst").alias("id"), "ts").agg(F.min("src").alias("by"))
        first = starts.select("id", F.lit(-1).cast("bigint").alias("start")).distinct()
        out = materialised(out.join(last, ["id", "ts"], "left").join(first, "id", "left").select("id", "ts", F.coalesce("start", "by").alias("parent")), "arrival")
    discarded(e)
    times.discard()
    return out


def spread_minimum(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label): the least label that edges (src, dst) carry to each id; only labels that changed are passed on.

    Steps are as many as the edges of the longest way that a label takes.
    """
    pairs = kept_by(edges.select("src", "dst").filter("src != dst").distinct(), "src")
    now = materialised(labels.select("id", "label"), "labels")
    changed = now
    while True:
        offers = pairs.join(changed.select(F.col("id").alias("src"), "label"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("new"))
        step = materialised(now.join(offers, "id", "left").select("id", F.least("label", "new").alias("label"), (F.col("new") < F.col("label")).alias("changed")), "labels")
        discarded(now)
        now, changed = step.select("id", "label"), step.filter("changed").select("id", "label")
        now._table_path = step._table_path
        if changed.isEmpty():
            pairs.unpersist()
            return now


def components(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, root, component): root is the least id from which directed paths lead to id; components are numbered by root."""
    roots = spread_minimum(edges, ids.select("id", F.col("id").alias("label"))).withColumnRenamed("label", "root")
    names = numbered(roots.select("root").distinct(), ["root"], "component")
    return roots.join(names, "root").select("id", "root", F.col("component").cast("bigint"))


def component_sizes(roots: DataFrame) -> DataFrame:
    """(root, size): how many ids each component has."""
    return roots.groupBy("root").agg(F.count("*").alias("size"))


def _least(links: DataFrame) -> DataFrame:
    """For each u of links (u, v): the least of u and its v."""
    return links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v")
    low = _least(down)
    stars = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return stars.filter("u != v").distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node with a link to another, the least node that links reach.

    Self links and nulls are ignored; no links give an empty result. Large and small stars alternate: each round is
    two pre-aggregated group-bys and joins. Rounds grow with the logarithm of the number of nodes, not with the length of paths.
    """
    now = materialised(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v").distinct(), "links")
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
        last, now = now, materialised(_small(_large(now)), "links")
        discarded(last)


def weak_components(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, root): the least id that paths in either direction reach."""
    roots = connected_components(edges.select("src", "dst"), "src", "dst").select(F.col("node").alias("id"), "component")
    return ids.select("id").join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("root"))
