"""The small golden graph, codec vectors, random graphs against plain models, sources and sinks."""

import gzip
import math
import pathlib
import random
import re
import shutil

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from arcwise.functions import codec
from arcwise.graph import TemporalGraph, run_workload, workload
from arcwise.operators import access, scores, storage, traversal
from arcwise.plans import session
from arcwise.sources import edges as sources, sinks
from arcwise.streaming import ingest

T0 = [(0, 1, 5), (0, 1, 9), (0, 2, 3), (1, 3, 4), (1, 3, 8), (2, 3, 2), (3, 0, 2), (3, 4, 12), (5, 6, 1), (6, 5, 1), (7, 2, 10)]


@pytest.fixture(scope="module")
def t0(spark):
    return TemporalGraph.from_edges(spark.createDataFrame(T0, sources.SCHEMA))


def by_id(df, *columns):
    rows = {r["id"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}
    return [rows[i] for i in sorted(rows)]


def test_degrees_and_neighbors(spark, t0):
    assert by_id(t0.out_degrees(), "degree") == [3, 2, 1, 2, 0, 1, 1, 1]
    assert tuple(access.degree_summary(t0.out_degrees()).first()) == (11, 11 / 8, 3, 0)
    pairs = spark.createDataFrame([(0, 1), (1, 0), (0, 1)], "u bigint, v bigint")
    assert sorted(map(tuple, t0.is_neighbor(pairs).collect())) == [(0, 1, True), (0, 1, True), (1, 0, False)]
    assert {r["linked"] for r in t0.is_neighbor(pairs.filter("u = 0"), 6, 9).collect()} == {True}
    assert {r["linked"] for r in t0.is_neighbor(pairs.filter("u = 0"), 6, 8).collect()} == {False}
    assert sorted(map(tuple, t0.first_contact().collect())) == [(0, 1, 5), (0, 2, 3), (1, 3, 4), (2, 3, 2), (3, 0, 2), (3, 4, 12), (5, 6, 1), (6, 5, 1), (7, 2, 10)]
    assert [tuple(r) for r in t0.successors(spark.createDataFrame([(0,)], "id bigint")).orderBy("nth").collect()] == [(0, 0, 1, 5), (0, 1, 1, 9), (0, 2, 2, 3)]


def test_searches(t0):
    assert {r["id"]: (r["dist"], r["parent"], r["ts"]) for r in t0.bfs(0).collect()} == {0: (0, -1, 0), 1: (1, 0, 5), 2: (1, 0, 3), 3: (2, 1, 4), 4: (3, 3, 12)}
    assert {r["id"]: r["ts"] for r in t0.earliest_arrival(0).collect()} == {0: 0, 1: 5, 2: 3}
    assert {r["id"]: r["ts"] for r in t0.earliest_arrival(0, contacts="all").collect()} == {0: 0, 1: 5, 2: 3, 3: 8, 4: 12}
    assert by_id(t0.components(), "root", "component") == [(0, 0)] * 5 + [(5, 1)] * 2 + [(7, 2)]
    assert by_id(t0.components(directed=False), "root") == [0, 0, 0, 0, 0, 5, 5, 0]


def test_degree_centrality(t0):
    assert by_id(t0.degree_centrality(), "degree", "mean_ts") == [(3, 6), (2, 6), (1, 2), (2, 7), (0, 0), (1, 1), (1, 1), (1, 10)]
    assert by_id(t0.degree_centrality(2, 9), "degree", "mean_ts") == [(3, 6), (2, 6), (1, 2), (1, 2), (1, 0), (1, 0), (1, 0), (1, 0)]


def close(got, want):
    assert all(math.isclose(a, b, abs_tol=1e-6) for a, b in zip(got, want, strict=True))


def test_scores(t0):
    close(by_id(t0.page_rank(2), "rank"), [0.023028, 0.021914, 0.030908, 0.037981, 0.035240, 0.021085, 0.021085, 0.018750])
    close(by_id(t0.page_rank(2, normalize=True), "rank"), [0.096134, 0.086155, 0.166755, 0.230135, 0.205572, 0.078723, 0.078723, 0.057803])
    h = t0.hits(2)
    close(by_id(h, "hub"), [0.645497, 0.258199, 0.258199, 0.516398, 0, 0.129099, 0.129099, 0.387298])
    close(by_id(h, "authority"), [0.339276, 0.424094, 0.678551, 0.339276, 0.339276, 0.084819, 0.084819, 0])
    assert [r["id"] for r in scores.top_ranks(t0.page_rank(2), 3).collect()] == [3, 4, 2]


def test_coloring(spark, t0):
    assert by_id(scores.sequence_priorities(spark, 8, block=3), "priority") == [185, 60, 253, 77, 64, 146, 155, 66]
    assert by_id(t0.ids.select("id", scores.hash_priority().alias("p")), "p") == [0, 158, 60, 218, 120, 23, 181, 83]
    assert by_id(t0.color("java"), "color") == [1, 3, 0, 2, 0, 1, 0, 1]
    assert by_id(t0.color("hash"), "color") == [2, 1, 1, 0, 0, 1, 0, 0]
    assert by_id(t0.color("java", max_rounds=2), "color") == [1, None, 0, None, 0, 1, 0, 1]


def test_code_lengths(spark, t0):
    x = spark.range(9).orderBy("id")
    lengths = lambda c: [r[0] for r in x.select(c).collect()]
    assert lengths(codec.gamma_bits("id")) == [1, 3, 3, 5, 5, 5, 5, 7, 7]
    assert lengths(codec.zeta_bits("id", 2)) == [2, 3, 3, 5, 5, 5, 5, 6, 6]
    assert lengths(codec.zeta_bits("id", 3)) == [3, 4, 4, 4, 4, 4, 4, 7, 7]
    assert lengths(codec.delta_bits("id")) == [1, 4, 4, 5, 5, 5, 5, 8, 8]
    assert lengths(codec.nibble_bits("id")) == [4, 4, 4, 4, 4, 4, 4, 4, 8]
    assert lengths(codec.golomb_bits("id", 3)) == [2, 3, 3, 3, 4, 4, 4, 5, 5]
    assert [r[0] for r in spark.range(-3, 4).orderBy("id").select(codec.int2nat("id")).collect()] == [5, 3, 1, 0, 2, 4, 6]
    bits = {(r["k"], r["factor"]): r["time_bits"] for r in t0.sweep((2,), (1, 5)).collect()}
    assert bits == {(2, 1): 119, (2, 5): 95}


def test_time_buckets(spark):
    one = spark.range(1)
    got = one.select(codec.bucket(F.lit(109).cast("bigint"), 10), codec.bucket_difference(F.lit(100).cast("bigint"), F.lit(115).cast("bigint"), 10), codec.bucket_reverse(F.lit(100), F.lit(1), 10)).first()
    assert tuple(got) == (100, 1, 110)
    with pytest.raises(ValueError):
        codec.bucket("id", 0)


def test_runs(spark):
    runs = spark.createDataFrame([(1, 3, 2), (1, 7, 3)], "src bigint, dst bigint, len bigint")
    assert [r["dst"] for r in storage.expand_multiples(runs).collect()] == [3, 3, 7, 7, 7]


edge = st.tuples(st.integers(0, 9), st.integers(0, 9), st.integers(-50, 50))


@settings(max_examples=5, deadline=None)
@given(st.lists(edge, min_size=1, max_size=40), st.sampled_from([1, 3, 10]))
def test_times_round_trip(spark, rows, factor):
    e = spark.createDataFrame(rows, sources.SCHEMA)
    low = min(t for _, _, t in rows)
    got = storage.decode_times(storage.encode_times(e, factor), low, factor)
    cut = lambda t: int(t / factor) * factor
    assert sorted((r["src"], r["dst"], r["ts"]) for r in got.collect()) == sorted((s, d, cut(t)) for s, d, t in rows)
    parts = [storage.expand_multiples(storage.multiples(e)), storage.expand_intervals(storage.intervals(e, 3)), storage.residuals(e, 3).select("src", "dst")]
    assert sorted((r[0], r[1]) for p in parts for r in p.collect()) == sorted((s, d) for s, d, _ in rows)


def reach_model(n, rows):
    out = {}
    for s in range(n):
        seen, todo = {s}, [s]
        while todo:
            u = todo.pop()
            for a, b, _ in rows:
                if a == u and b not in seen:
                    seen.add(b)
                    todo.append(b)
        for v in seen:
            out.setdefault(v, s)
    return [out[v] for v in range(n)]


def color_model(n, rows, p):
    done, c = {}, 0
    while len(done) < n:
        now = [u for u in range(n) if u not in done and all(v in done and done[v] < c for a, v, _ in rows if a == u and v != u and (p[v] > p[u] or (p[v] == p[u] and v < u)))]
        done |= dict.fromkeys(now, c)
        c += 1
    return [done[u] for u in range(n)]


def bfs_model(n, rows, start):
    first = {}
    for s, d, t in rows:
        first[s, d] = min(t, first.get((s, d), t))
    seen, queue = {start: (0, -1, 0)}, [start]
    for u in queue:
        for v in range(n):
            if (u, v) in first and v not in seen:
                seen[v] = (seen[u][0] + 1, u, first[u, v])
                queue.append(v)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    n = 25
    rows = [(r.randrange(n), r.randrange(n), r.randrange(60)) for _ in range(45)]
    g = TemporalGraph.from_edges(spark.createDataFrame(rows, sources.SCHEMA), 0, n)
    assert by_id(g.components(), "root") == reach_model(n, rows)
    p = by_id(scores.sequence_priorities(spark, n), "priority")
    assert by_id(g.color(), "color") == color_model(n, rows, p)
    assert {x["id"]: (x["dist"], x["parent"], x["ts"]) for x in g.bfs(rows[0][0]).collect()} == bfs_model(n, rows, rows[0][0])
    times = {x["id"]: x["ts"] for x in g.earliest_arrival(rows[0][0], contacts="all").collect()}
    best = {rows[0][0]: 0}
    for _ in range(n):
        for s, d, t in rows:
            if s in best and best[s] <= t < best.get(d, 99):
                best[d] = t
    assert times == best
    h = g.hits(3).collect()
    assert math.isclose(sum(x["hub"] ** 2 for x in h), 1) and math.isclose(sum(x["authority"] ** 2 for x in h), 1)


def test_views_and_workloads(spark, t0):
    view = t0.active(0, 4)
    assert view.first_contact().count() == 5 and view.window(3, 5).edges.count() == 3
    data = sources.Dataset("T", 7, rank_iterations=2, random_access=True)
    for name in ("ra", "BFS", "connected-components", "page_rank", "hits", "DC", "gc"):
        assert run_workload(t0, name, data).count() > 0
    assert workload("graph-coloring") == "GC"
    with pytest.raises(ValueError):
        workload("sort")
    assert t0.stats().first()["arcs"] == 11 and t0.bucketed(5).edges.filter("ts % 5 != 0").count() == 0


def test_datasets(monkeypatch, tmp_path):
    assert sources.dataset("cbtcomm").name == "Comm" and sources.dataset("yahoo_sub").active == (2_000, 102_867_215)
    with pytest.raises(KeyError):
        sources.dataset("nothing")
    monkeypatch.setenv("ARCWISE_DATA", str(tmp_path))
    assert sources.data_root() == str(tmp_path) and sources.data_root("/x") == "/x"


def test_text_edges(spark, tmp_path):
    path = tmp_path / "raw" / "Comm.raw.txt.gz"
    path.parent.mkdir()
    with gzip.open(path, "wt") as f:
        f.write("".join(f"{s}\t{d} 1  {t}\n\n" for s, d, t in T0))
    data = sources.dataset("comm")
    for _ in range(2):
        assert sorted(map(tuple, sinks.ingest(spark, data, str(tmp_path)).collect())) == sorted(T0)
    assert sources.read_text_edges(spark, str(path), shift=5).agg(F.min("src")).first()[0] == 5
    (tmp_path / "head.txt").write_text("src dst w ts\n1 2 3 4\n")
    assert [tuple(r) for r in sources.read_text_edges(spark, str(tmp_path / "head.txt"), header=True, partitions=2).collect()] == [(1, 2, 4)]
    # Only the first line with text of each file is a header, whatever stands in it.
    (tmp_path / "heads").mkdir()
    (tmp_path / "heads" / "a.txt").write_text("\n7 8 9 10\n1 2 3 4\n\n1 \"3 4\" 5\n")
    (tmp_path / "heads" / "b.txt").write_text("src dst w ts\n5 6 7 8\n")
    with pytest.raises(Exception, match="not an edge"):
        sources.read_text_edges(spark, str(tmp_path / "heads"), header=True).collect()
    (tmp_path / "heads" / "a.txt").write_text("\n7 8 9 10\n1 2 3 4\n\n1 3 4 5\n")
    assert sorted(map(tuple, sources.read_text_edges(spark, str(tmp_path / "heads"), header=True, check_sorted=True).collect())) == [(1, 2, 4), (1, 3, 5), (5, 6, 8)]
    with pytest.raises(ValueError, match="sources decrease in .*a.txt, from 7 to 1"):
        sources.read_text_edges(spark, str(tmp_path / "heads" / "a.txt"), check_sorted=True)
    (tmp_path / "heads" / "a.txt").write_text("\n".join(f"{i} 1 1 1" for i in [*range(5000), 4000]))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")  # several splits of a file
        with pytest.raises(ValueError, match="from 4999 to 4000"):
            sources.read_text_edges(spark, str(tmp_path / "heads" / "a.txt"), check_sorted=True)
        (tmp_path / "heads" / "a.txt").write_text("\n".join(f"{i} 1 1 1" for i in range(5000)))
        assert sources.read_text_edges(spark, str(tmp_path / "heads" / "a.txt"), check_sorted=True).count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    for bad in ("1 2 3\n", "1 2 x 4\n", "-1 2 3 4\n"):
        (tmp_path / "bad.txt").write_text(bad)
        with pytest.raises(Exception, match="not an edge"):
            sources.read_text_edges(spark, str(tmp_path / "bad.txt")).collect()
    at = spark.createDataFrame([(i, s) for i, s in enumerate([1, 1, 3, 2, 5])], "pos bigint, src bigint")
    assert [tuple(r) for r in sources.unsorted_sources(at, "pos").collect()] == [(3, 2, 3)]


def test_stored_graph_and_stream(spark, t0, tmp_path):
    t0.write(str(tmp_path / "g"), partitions=3)
    assert sorted(map(tuple, TemporalGraph.read(spark, str(tmp_path / "g")).edges.collect())) == sorted(T0)
    assert TemporalGraph.read(spark, str(tmp_path / "g")).high == 8 and sinks.read_properties(spark, str(tmp_path / "g")) == {"low": 0, "high": 8}
    t0.active(2, 7).write(str(tmp_path / "s"), stats=True)
    assert sinks.read_properties(spark, str(tmp_path / "s"))["arcs"] == 11 and TemporalGraph.read(spark, str(tmp_path / "s")).low == 2
    stream = ingest.edge_stream(spark, str(tmp_path / "g"), 1)
    TemporalGraph.from_edges(spark.createDataFrame([(9, 9, 9)], sources.SCHEMA)).write(str(tmp_path / "out"))
    ingest.append_edges(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted([*T0, (9, 9, 9)])
    assert sinks.read_properties(spark, str(tmp_path / "out")) is None and TemporalGraph.read(spark, str(tmp_path / "out")).high == 10
    # A batch that is tried again takes the place of its files.
    shutil.rmtree(tmp_path / "check" / "commits")
    ingest.append_edges(ingest.edge_stream(spark, str(tmp_path / "g"), 1), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted([*T0, (9, 9, 9)])
    counts = ingest.windowed_degrees(ingest.edge_stream(spark, str(tmp_path / "g")), "10 seconds", "0 seconds")
    q = counts.writeStream.format("memory").queryName("degrees").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("degrees").agg(F.sum("n")).first()[0] == 11


def test_packed_degrees(spark, t0):
    out = sinks.packed_degrees(t0.out_degrees(), 4).orderBy("block").collect()
    assert [int.from_bytes(b[i : i + 4], "big") for r in out for b in [bytes(r["bytes"])] for i in range(0, 16, 4)] == [3, 2, 1, 2, 0, 1, 1, 1]


def test_command_line(spark, tmp_path, capsys):
    from arcwise.__main__ import main

    path = tmp_path / "raw" / "Comm.raw.txt.gz"
    path.parent.mkdir()
    with gzip.open(path, "wt") as f:
        f.write("".join(f"{s} {d} 1 {t}\n" for s, d, t in sorted(T0)))
    main(["comm", "--root", str(tmp_path), "--prepare-only"])
    assert capsys.readouterr().out == "" and (tmp_path / "stored" / "Comm" / "_SUCCESS").exists()
    main(["Comm", "bfs", "--root", str(tmp_path), "--out", str(tmp_path / "out")])
    assert re.fullmatch(r"RESULT dataset=Comm workload=BFS rows=5 elapsed_ns=\d+\n", capsys.readouterr().out)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_walk_in_narrow_buckets(spark, tables):
    rows = [sorted(map(tuple, sources.event_walk(spark, tables, n).collect())) for n in (7, 100_000)]
    assert rows[0] == rows[1] and len(rows[0]) > 100


def test_hubs_are_read_as_a_stream(spark):
    r = random.Random(8)
    rows = [(r.choice([1, 1, 1, 2, 3]), r.randrange(9), r.randrange(-50, 100)) for _ in range(300)]
    e, ids = spark.createDataFrame(rows, sources.SCHEMA), spark.range(0, 5)
    whole, parts = (sorted(map(tuple, access.degree_centrality(e, ids, hub=h).collect())) for h in (1000, 70))
    assert whole == parts and whole[4] == (4, 0, 0)


def test_long_paths_take_few_rounds(spark, monkeypatch):
    n, rounds = 5000, []
    e = spark.range(n - 1).selectExpr("id * 7919 % 5000 as src", "(id + 1) * 7919 % 5000 as dst", "0L as ts")
    monkeypatch.setattr(traversal, "discarded", lambda *t: rounds.append(t))
    roots = traversal.weak_components(e, spark.range(n + 1))
    assert {r["id"]: r["root"] for r in roots.collect()} == {**dict.fromkeys(range(n), 0), n: n}
    assert len(rounds) < 30


def test_coloring_is_the_same_in_one_task_and_in_rounds(spark):
    r = random.Random(12)
    rows = [(r.randrange(40), r.randrange(40), 0) for _ in range(300)]
    e, p = spark.createDataFrame(rows, sources.SCHEMA), spark.range(45).selectExpr("id", "id * 7 % 5 as priority")
    for most in (512, 3, 1):
        whole, rounds, some = (sorted(map(tuple, scores.color(e, p, most, local_arcs=k).collect())) for k in (10**6, 0, 60))
        assert whole == rounds == some
        assert max(c for _, c in whole if c is not None) == (most - 1 if most < 9 else max(c for _, c in whole)) and len(whole) == 45


def test_arrival_parents_and_rank_sum(spark, t0):
    got = {r["id"]: (r["ts"], r["parent"]) for r in traversal.earliest_arrival(t0.edges, spark.createDataFrame([(0,)], "id bigint"), "all", parents=True).collect()}
    assert got == {0: (0, -1), 1: (5, 0), 2: (3, 0), 3: (8, 1), 4: (12, 3)}
    assert traversal.bfs(t0.edges, 0, parents=False).columns == ["id", "dist"]
    total = scores.rank_sum(t0.page_rank(2, normalize=True)).first()
    assert math.isclose(total["total"], 1) and total["ids"] == 8
    assert sorted(map(tuple, traversal.component_sizes(traversal.weak_components(t0.edges, t0.ids)).collect())) == [(0, 6), (5, 2)]


def test_tables_have_few_files_and_go(spark, tmp_path):
    many = spark.range(0, 1000, 1, 64)
    table = session.materialised(many, "few")
    assert len(table.inputFiles()) <= 8 and table.count() == 1000  # two for each of four cores
    assert len(session.materialised(many, "few", 3).inputFiles()) == 3
    many.write.parquet(str(tmp_path / "many"))
    read = spark.read.parquet(str(tmp_path / "many"))
    assert session.table_files(read) == 8 and session.few_files(read, read).rdd.getNumPartitions() <= 8
    assert session.table_files(spark.createDataFrame([(1,)], "x int")) > 1 << 20  # of unknown size: no bound
    folder = pathlib.Path(table._table_path.removeprefix("file:"))
    assert folder.exists()
    session.discarded(table)
    assert not folder.exists()


def test_grown_tables_and_kept_edges(spark, t0):
    grown = session.Grown(spark, "id bigint", "ids")
    for part in (spark.range(3), spark.range(3, 5), spark.range(0)):
        grown.add(part)
    assert sorted(r["id"] for r in grown.rows.collect()) == [0, 1, 2, 3, 4]
    kept = session.kept_by(t0.edges, "src")
    assert kept.groupBy(F.spark_partition_id().alias("part"), "src").count().groupBy("src").count().filter("count > 1").isEmpty()
    kept.unpersist()


def test_arrival_along_a_long_path_takes_few_steps(spark, monkeypatch):
    """Steps don't grow with the contacts of a path."""
    n = 400
    edges = spark.createDataFrame([(i, i + 1, 10 + i) for i in range(n)], "src bigint, dst bigint, ts bigint")
    steps, add = [], traversal.Grown.add
    monkeypatch.setattr(traversal.Grown, "add", lambda self, df: steps.append(1) or add(self, df) if len(steps) < 20 else pytest.fail("a step for each contact"))
    got = {r["id"]: r["ts"] for r in traversal.earliest_arrival(edges, spark.createDataFrame([(0,)], "id bigint"), "all").collect()}
    assert got == {0: 0} | {i + 1: 10 + i for i in range(n)}
    assert len(steps) <= 2


@pytest.mark.parametrize("local", [4, 40, 1000])
def test_arrival_in_slices_equals_plain_python(spark, local):
    """Slices of few contacts, ties in time across a whole slice, times before the start, and contacts without an end."""
    import random

    r = random.Random(local)
    rows = [(r.randrange(40), r.randrange(40), r.choice([-3, 0, 5, 5, 5, r.randrange(60)])) for _ in range(150)] + [(None, 3, 1), (3, None, 50), (1, 2, None)]
    links = [x for x in rows if None not in x]
    best, more = {0: 0, 7: 0}, True
    while more:
        more = False
        for a, b, t in links:
            if a in best and best[a] <= t and t < best.get(b, 1 << 40):
                best[b], more = t, True
    parent = {i: -1 if i in (0, 7) else min(a for a, b, t in links if b == i and t == ts and best.get(a, 1 << 40) <= t) for i, ts in best.items()}
    edges, starts = spark.createDataFrame(rows, "src bigint, dst bigint, ts bigint"), spark.createDataFrame([(0,), (7,)], "id bigint")
    got = {x["id"]: (x["ts"], x["parent"]) for x in traversal.earliest_arrival(edges, starts, "all", parents=True, local=local).collect()}
    got.pop(None, None)
    assert got == {i: (ts, parent[i]) for i, ts in best.items()}
