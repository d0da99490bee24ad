"""Registered queries over the graph views of the star-schema tables, each with equivalent SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from arcwise.functions import codec
from arcwise.operators import access, scores, storage, traversal
from arcwise.plans.session import gone_at_exit, materialised, new_path
from arcwise.sources import edges as sources, sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Views in SQL: the event walk and trades.
WALK = """w0 AS (SELECT user_id, lead(user_id) OVER (ORDER BY ts, event_id) AS dst, ts, event_id FROM events),
walk AS (SELECT CAST(user_id AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id FROM w0 WHERE dst IS NOT NULL),
ids AS (SELECT unnest(range(0, (SELECT max(greatest(src, dst)) + 1 FROM walk))) AS id),
fc AS (SELECT src, dst, min(ts) AS ts FROM walk GROUP BY src, dst)"""
TRADES = """trades AS (SELECT CAST(o_custkey AS BIGINT) AS src, CAST(l_suppkey + 1000000 AS BIGINT) AS dst,
    CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def query(sql: str | None = None, views: str = WALK, recursive: bool = False):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{views}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
        return f

    return register


def walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.event_walk(spark, sf_dir).select("src", "dst", "ts")


def walk_ids(spark: SparkSession, edges: DataFrame) -> DataFrame:
    top = edges.agg(F.max(F.greatest("src", "dst")).alias("top")).first()["top"]
    return access.vertices(spark, 0, (top if top is not None else -1) + 1)


def _whole(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The walk, written once, and its ids."""
    e = materialised(walk(spark, sf_dir), "walk")
    return e, walk_ids(spark, e)


def _first(spark: SparkSession, edges: DataFrame, column: str = "src") -> int:
    return edges.agg(F.min(column).alias("x")).first()["x"] or 0


# Sources and sinks

@query("SELECT src, dst, ts FROM walk")
def s6_event_walk(spark, sf_dir):
    return walk(spark, sf_dir)


@query("SELECT id FROM ids")
def s10_node_scan(spark, sf_dir):
    return walk_ids(spark, walk(spark, sf_dir))


@query("SELECT src, dst, ts FROM trades", TRADES)
def s6_trades(spark, sf_dir):
    return sources.trades(spark, sf_dir)


@query("SELECT src, dst, ts FROM walk")
def k1_stored_graph(spark, sf_dir):
    path = new_path(spark, "graph")
    sinks.write_graph(walk(spark, sf_dir), path)
    gone_at_exit(spark, path)
    return sources.read_edges(spark, path)


@query("SELECT src, dst, ts FROM walk")
def k8_recompressed(spark, sf_dir):
    """A stored graph, read and stored again with another codec."""
    first, second = new_path(spark, "graph"), new_path(spark, "graph")
    sinks.write_graph(walk(spark, sf_dir), first)
    sinks.write_graph(sources.read_edges(spark, first), second, compression="snappy")
    gone_at_exit(spark, first)
    gone_at_exit(spark, second)
    return sources.read_edges(spark, second)


@query("SELECT src + 5 AS src, dst + 5 AS dst, ts FROM walk")
def k4_text_round_trip(spark, sf_dir):
    path = new_path(spark, "text")
    sinks.export_text(walk(spark, sf_dir), path, shift=2, temporal=True)
    gone_at_exit(spark, path)
    return sources.read_text_edges(spark, path, shift=3)


@query(""", d AS (SELECT id, count(src) AS degree FROM ids LEFT JOIN walk ON src = id GROUP BY id)
    SELECT id // 64 AS block, lower(string_agg(lpad(to_hex(degree), 8, '0'), '' ORDER BY id)) AS bytes FROM d GROUP BY 1""")
def k5_packed_degrees(spark, sf_dir):
    e = walk(spark, sf_dir)
    return sinks.packed_degrees(access.out_degrees(e, walk_ids(spark, e)), 64).select("block", F.lower(F.hex("bytes")).alias("bytes"))


# Neighbour access

@query("SELECT src, row_number() OVER (PARTITION BY src ORDER BY dst, ts) - 1 AS nth, dst, ts FROM walk")
def n1_successors(spark, sf_dir):
    return access.successors(walk(spark, sf_dir))


@query("SELECT src, dst FROM walk")
def n2_adjacency(spark, sf_dir):
    return access.adjacency(walk(spark, sf_dir))


_PAIRS = ", p AS (SELECT id AS u, (id * 7 + 3) % (SELECT count(*) FROM ids) AS v FROM ids)"


def _pairs(spark, edges):
    ids = walk_ids(spark, edges)
    return ids.select(F.col("id").alias("u"), ((F.col("id") * 7 + 3) % ids.count()).alias("v"))


@query(_PAIRS + "SELECT u, v, EXISTS (SELECT 1 FROM walk WHERE src = u AND dst = v) AS linked FROM p")
def n3_is_neighbor(spark, sf_dir):
    e = walk(spark, sf_dir)
    return access.are_neighbors(_pairs(spark, e), e)


@query(_PAIRS + ", t AS (SELECT min(ts) AS low FROM walk) SELECT u, v, EXISTS (SELECT 1 FROM walk, t WHERE src = u AND dst = v AND ts BETWEEN low + 3600 AND low + 864000) AS linked FROM p")
def n4_is_neighbor_between(spark, sf_dir):
    e = walk(spark, sf_dir)
    low = _first(spark, e, "ts")
    return access.are_neighbors(_pairs(spark, e), e, low + 3600, low + 864_000)


@query("SELECT id, count(src) AS degree FROM ids LEFT JOIN walk ON src = id GROUP BY id")
def n5_out_degrees(spark, sf_dir):
    e = walk(spark, sf_dir)
    return access.out_degrees(e, walk_ids(spark, e))


@query("SELECT src, count(*) AS n, min(ts) AS min_ts, max(ts) AS max_ts, CAST(sum(dst) AS BIGINT) AS sum_dst FROM trades GROUP BY src", TRADES)
def n6_full_scan(spark, sf_dir):
    return access.scan_digest(sources.trades(spark, sf_dir))


@query(""", p AS (SELECT probe, ((probe + 12345) * 2654435761 % 4294967296) % (SELECT count(*) FROM ids) AS id FROM (SELECT unnest(range(0, (SELECT count(*) FROM ids))) AS probe)),
    d AS (SELECT src, count(*) AS n, min(ts) AS min_ts, max(ts) AS max_ts, CAST(sum(dst) AS BIGINT) AS sum_dst FROM walk GROUP BY src)
    SELECT probe, id, coalesce(n, 0) AS n, min_ts, max_ts, sum_dst FROM p LEFT JOIN d ON src = id""")
def n7_random_probes(spark, sf_dir):
    e, ids = _whole(spark, sf_dir)
    n = ids.count()
    return access.random_access(access.hashed_probes(spark, n, 0, n), e)


@query("SELECT src, dst, ts FROM walk WHERE src BETWEEN 5 AND 89 AND dst BETWEEN 5 AND 89")
def n8_active_range(spark, sf_dir):
    return access.active(walk(spark, sf_dir), 5, 90)


@query("SELECT src, dst, ts FROM fc")
def n9_first_contacts(spark, sf_dir):
    return access.first_contacts(walk(spark, sf_dir))


@query("SELECT * FROM (SELECT src, row_number() OVER (PARTITION BY src ORDER BY dst, ts) - 1 AS nth, dst, ts FROM walk) WHERE nth >= 5")
def n10_skip(spark, sf_dir):
    return access.skipped(walk(spark, sf_dir), 5)


@query("SELECT id, count(src) < 4 AS low FROM ids LEFT JOIN walk ON src = id GROUP BY id")
def n11_low_degree(spark, sf_dir):
    return access.low_degree(access.out_degrees(*_whole(spark, sf_dir)))


@query(", d AS (SELECT id, count(src) AS n FROM ids LEFT JOIN walk ON src = id GROUP BY id) SELECT count(*) FILTER (n > 9) AS seeds, count(*) FILTER (n <= 9) AS others FROM d")
def n12_seed_filter(spark, sf_dir):
    return access.seed_counts(access.out_degrees(*_whole(spark, sf_dir)))


@query("SELECT a.src, count(b.dst) AS copied, count(*) - count(b.dst) AS extra FROM fc a LEFT JOIN fc b ON b.src = a.src - 1 AND b.dst = a.dst GROUP BY a.src")
def j7_copied_arcs(spark, sf_dir):
    return access.copied_arcs(walk(spark, sf_dir), 1)


# Degrees

@query("SELECT id, count(src) AS degree, coalesce(avg(ts), 0) AS mean_ts FROM ids LEFT JOIN walk ON src = id GROUP BY id")
def d1_degree_centrality(spark, sf_dir):
    e = walk(spark, sf_dir)
    return access.degree_centrality(e, walk_ids(spark, e), mean="exact").withColumn("mean_ts", F.col("mean_ts").cast("double"))


_RUNNING = "coalesce(list_reduce(list(ts ORDER BY dst, ts) FILTER (ts IS NOT NULL), lambda m, t, i: m + (t - m) // i), 0)"


@query(f"SELECT src AS id, count(*) AS degree, CAST({_RUNNING} AS BIGINT) AS mean_ts FROM trades GROUP BY src", TRADES)
def a9_running_mean(spark, sf_dir):
    e = sources.trades(spark, sf_dir)
    return access.degree_centrality(e, e.select(F.col("src").alias("id")).distinct())


@query(""", b AS (SELECT min(ts) + 86400 AS low, min(ts) + 1728000 AS high FROM walk),
    x AS (SELECT id, count(src) AS n, coalesce(avg(ts), 0) AS m FROM ids LEFT JOIN (SELECT walk.* FROM walk, b WHERE ts BETWEEN low AND high) ON src = id GROUP BY id)
    SELECT id, CAST(trunc(0.85::DOUBLE * n + 0.15::DOUBLE * n * (m - low) / (high - low) + 1) AS BIGINT) AS degree, CAST(m AS DOUBLE) AS mean_ts FROM x, b""")
def d1_degree_window(spark, sf_dir):
    e = walk(spark, sf_dir)
    low = _first(spark, e, "ts")
    return access.degree_centrality(e, walk_ids(spark, e), low + 86_400, low + 1_728_000, mean="exact").withColumn("mean_ts", F.col("mean_ts").cast("double"))


@query(", d AS (SELECT id, count(src) AS degree FROM ids LEFT JOIN walk ON src = id GROUP BY id) SELECT CAST(sum(degree) AS BIGINT) AS total, avg(degree) AS mean, max(degree) AS most, arg_min(id, (-degree) * 1000000 + id) AS at FROM d")
def d2_degree_summary(spark, sf_dir):
    e = walk(spark, sf_dir)
    return access.degree_summary(access.out_degrees(e, walk_ids(spark, e)))


# Storage

@query("SELECT min(ts) AS min_ts FROM walk")
def a1_min_time(spark, sf_dir):
    return storage.min_time(walk(spark, sf_dir))


def _nat(x: str) -> str:
    return f"CASE WHEN {x} >= 0 THEN 2 * ({x}) ELSE -2 * ({x}) - 1 END"


def _log(x: str) -> str:
    return f"(length(bin({x})) - 1)"


def _gamma(x: str) -> str:
    return f"(2 * {_log(f'({x}) + 1')} + 1)"


def _zeta(x: str, k) -> str:
    h = f"({_log(f'({x}) + 1')} // {k})"
    return f"({h} + 1 + {h} * {k} + {k} - 1 + CASE WHEN {_log(f'({x}) + 1')} >= {h} * {k} + 1 THEN 1 ELSE 0 END)"


_ENCODED = f""", e0 AS (SELECT src, row_number() OVER o - 1 AS nth, dst, ts, coalesce(lag(ts) OVER o, (SELECT min(ts) FROM walk)) AS before FROM walk WINDOW o AS (PARTITION BY src ORDER BY dst, ts)),
enc AS (SELECT src, nth, dst, {_nat('ts - before')} AS delta FROM e0)"""


@query(_ENCODED + "SELECT src, nth, dst, delta FROM enc")
def w3_encoded_times(spark, sf_dir):
    return storage.encode_times(walk(spark, sf_dir))


@query("SELECT src, row_number() OVER (PARTITION BY src ORDER BY dst, ts) - 1 AS nth, dst, ts // 60 * 60 AS ts FROM walk")
def k3_stored_times(spark, sf_dir):
    """The time stream and its index, stored and read back; the index says where each source's times start."""
    e = walk(spark, sf_dir)
    path = new_path(spark, "times")
    sinks.write_times(storage.encode_times(e, 60), storage.offsets(e), path)
    gone_at_exit(spark, path)
    times, index = sinks.read_times(spark, path)
    return storage.decode_times(times.join(index, "src", "left_semi"), _first(spark, e, "ts"), 60)


@query("SELECT src, row_number() OVER (PARTITION BY src ORDER BY dst, ts) - 1 AS nth, dst, ts // 60 * 60 AS ts FROM walk")
def w3_decoded_times(spark, sf_dir):
    e = walk(spark, sf_dir)
    return storage.decode_times(storage.encode_times(e, 60), _first(spark, e, "ts"), 60)


@query("SELECT src, dst, count(*) AS len FROM walk GROUP BY src, dst HAVING count(*) >= 2")
def w4_multiples(spark, sf_dir):
    return storage.multiples(walk(spark, sf_dir))


_LISTS = f""", s0 AS (SELECT src, dst FROM walk GROUP BY src, dst HAVING count(*) = 1),
s1 AS (SELECT src, dst, dst - row_number() OVER (PARTITION BY src ORDER BY dst) AS island FROM s0),
isl AS (SELECT src, island, min(dst) AS start, count(*) AS len FROM s1 GROUP BY src, island),
itv AS (SELECT src, start, len FROM isl WHERE len >= 3),
res0 AS (SELECT s1.src, s1.dst, lag(s1.dst) OVER (PARTITION BY s1.src ORDER BY s1.dst) AS before FROM s1 JOIN isl USING (src, island) WHERE len < 3),
res AS (SELECT src, dst, CASE WHEN before IS NULL THEN {_nat('dst - src')} ELSE dst - before - 1 END AS gap FROM res0),
mul0 AS (SELECT src, dst, count(*) AS len FROM walk GROUP BY src, dst HAVING count(*) >= 2),
mul1 AS (SELECT *, lag(dst) OVER (PARTITION BY src ORDER BY dst) AS before FROM mul0),
mul AS (SELECT src, dst, CASE WHEN before IS NULL THEN {_nat('dst - src')} ELSE dst - before - 1 END AS gap, len - 2 AS extra FROM mul1),
itg0 AS (SELECT *, lag(start + len) OVER (PARTITION BY src ORDER BY start) AS before FROM itv),
itg AS (SELECT src, start, CASE WHEN before IS NULL THEN {_nat('start - src')} ELSE start - before - 1 END AS gap, len - 3 AS extra FROM itg0)"""


@query(_LISTS + "SELECT src, start, len FROM itv")
def w5_intervals(spark, sf_dir):
    return storage.intervals(walk(spark, sf_dir), 3)


@query(_LISTS + "SELECT src, dst, gap FROM res")
def w6_residuals(spark, sf_dir):
    return storage.residuals(walk(spark, sf_dir), 3)


@query(_LISTS + "SELECT src, dst, gap, extra FROM mul")
def w7_multiple_gaps(spark, sf_dir):
    return storage.multiple_gaps(walk(spark, sf_dir))


@query(_LISTS + "SELECT src, start, gap, extra FROM itg")
def w8_interval_gaps(spark, sf_dir):
    return storage.interval_gaps(walk(spark, sf_dir), 3)


@query("SELECT src, dst FROM walk JOIN (SELECT src, dst FROM walk GROUP BY src, dst HAVING count(*) >= 2) USING (src, dst)")
def w9_expanded_multiples(spark, sf_dir):
    return storage.expand_multiples(storage.multiples(walk(spark, sf_dir)))


@query(_LISTS + "SELECT src, dst FROM s1 JOIN isl USING (src, island) WHERE len >= 3")
def w10_expanded_intervals(spark, sf_dir):
    return storage.expand_intervals(storage.intervals(walk(spark, sf_dir), 3))


@query(f""", g0 AS (SELECT src, dst, lag(dst) OVER (PARTITION BY src ORDER BY dst) AS before FROM fc),
    g AS (SELECT CASE WHEN before IS NULL THEN {_nat('dst - src')} ELSE dst - before END AS gap FROM g0)
    SELECT CAST(CASE WHEN gap > 0 THEN {_log('greatest(gap, 1)')} ELSE -1 END AS BIGINT) AS bin, count(*) AS n, CAST(sum(gap) AS BIGINT) AS total FROM g GROUP BY 1""")
def a6_gap_histogram(spark, sf_dir):
    return storage.gap_histogram(walk(spark, sf_dir))


@query(_LISTS + f" SELECT CAST(CASE WHEN gap > 0 THEN {_log('greatest(gap, 1)')} ELSE -1 END AS BIGINT) AS bin, count(*) AS n, CAST(sum(gap) AS BIGINT) AS total FROM res GROUP BY 1")
def a6_residual_histogram(spark, sf_dir):
    return storage.residual_histogram(walk(spark, sf_dir), 3)


@query("SELECT src, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS nth, dst FROM walk")
def j8_merged_lists(spark, sf_dir):
    return storage.merged(walk(spark, sf_dir), 3)


#: A run's number counts the changes between copied and skipped before it, from copied on.
_REFERENCES = f""", o AS (SELECT DISTINCT src, dst FROM walk),
m AS (SELECT a.src + ref AS src, ref, a.dst, o.dst IS NOT NULL AS hit FROM (SELECT src, dst, unnest(range(1, 8)) AS ref FROM o) a SEMI JOIN o h ON h.src = a.src + ref LEFT JOIN o ON o.src = a.src + ref AND o.dst = a.dst),
m1 AS (SELECT *, CASE WHEN hit <> lag(hit, 1, true) OVER (PARTITION BY src, ref ORDER BY dst) THEN 1 ELSE 0 END AS turn FROM m),
m2 AS (SELECT *, sum(turn) OVER (PARTITION BY src, ref ORDER BY dst) AS run FROM m1),
m3 AS (SELECT src, ref, run, count(*) AS len, bool_or(hit) AS hit, max(run) OVER (PARTITION BY src, ref) AS last FROM m2 GROUP BY src, ref, run),
bl AS (SELECT src, ref, sum(CASE WHEN hit THEN len ELSE 0 END) AS copied, {_gamma('max(last)')} + sum(CASE WHEN run < last THEN CASE WHEN run = 0 THEN {_gamma('len')} ELSE {_gamma('(len - 1)')} END ELSE 0 END) + CASE WHEN min(run) > 0 THEN 1 ELSE 0 END AS b FROM m3 GROUP BY src, ref),
ev AS (SELECT src, ref FROM bl UNION ALL SELECT DISTINCT src, 0 FROM o),
x0 AS (SELECT o.src, ev.ref, o.dst FROM o JOIN ev USING (src) ANTI JOIN (SELECT * FROM m WHERE hit) y ON y.src = o.src AND y.ref = ev.ref AND y.dst = o.dst),
x1 AS (SELECT *, lag(dst) OVER (PARTITION BY src, ref ORDER BY dst) AS before FROM x0),
x2 AS (SELECT src, ref, CASE WHEN before IS NULL THEN {_nat('dst - src')} ELSE dst - before - 1 END AS gap FROM x1),
x3 AS (SELECT src, ref, count(*) AS extra, sum({_zeta('gap', 3)}) AS b FROM x2 GROUP BY src, ref),
rf AS (SELECT ev.src, ev.ref, CAST(coalesce(copied, 0) AS BIGINT) AS copied, CAST(coalesce(extra, 0) AS BIGINT) AS extra, CAST(ev.ref + 1 + coalesce(bl.b, 0) + coalesce(x3.b, 0) AS BIGINT) AS bits
    FROM ev LEFT JOIN bl USING (src, ref) LEFT JOIN x3 USING (src, ref)),
best AS (SELECT * FROM rf QUALIFY row_number() OVER (PARTITION BY src ORDER BY bits, ref) = 1)"""


@query(_REFERENCES + " SELECT src, ref, copied, extra, bits FROM rf")
def c9_reference_bits(spark, sf_dir):
    return storage.reference_bits(walk(spark, sf_dir))


@query(_REFERENCES + " SELECT src, ref, copied, extra, bits FROM best")
def w11_best_references(spark, sf_dir):
    return storage.best_references(walk(spark, sf_dir))


@query(_REFERENCES + ", d AS (SELECT src, ref, 0 AS depth FROM best WHERE ref = 0 UNION ALL SELECT b.src, b.ref, d.depth + 1 FROM best b JOIN d ON d.src = b.src - b.ref AND b.ref > 0) SELECT CAST(depth AS BIGINT) AS depth, count(*) AS n FROM d GROUP BY 1", recursive=True)
def a8_reference_depths(spark, sf_dir):
    return storage.reference_depths(storage.best_references(walk(spark, sf_dir)))


def _stirling(x: str) -> str:
    return f"({x} * ln({x}) - {x} + 0.5 * ln(2 * pi() * {x}))"


_BITS = f"""{_ENCODED}{_LISTS.replace('len >= 3', 'len >= 4').replace('len < 3', 'len < 4').replace('len - 3', 'len - 4')},
tb AS (SELECT src, count(*) AS arcs, sum({_zeta('delta', 2)}) AS t FROM enc GROUP BY src),
mb AS (SELECT src, count(*) AS c, sum({_gamma('gap')} + {_gamma('extra')}) AS b FROM mul GROUP BY src),
ib AS (SELECT src, count(*) AS c, sum({_gamma('gap')} + {_gamma('extra')}) AS b FROM itg GROUP BY src),
rb AS (SELECT src, sum({_zeta('gap', 3)}) AS b FROM res GROUP BY src),
nb AS (SELECT tb.src, arcs, CAST(t AS BIGINT) AS time_bits, CAST({_gamma('coalesce(mb.c, 0)')} + coalesce(mb.b, 0) AS BIGINT) AS multiple_bits,
    CAST({_gamma('coalesce(ib.c, 0)')} + coalesce(ib.b, 0) AS BIGINT) AS interval_bits, CAST(coalesce(rb.b, 0) AS BIGINT) AS residual_bits
    FROM tb LEFT JOIN mb USING (src) LEFT JOIN ib USING (src) LEFT JOIN rb USING (src))"""


@query(_BITS + "SELECT * FROM nb")
def c9_node_bits(spark, sf_dir):
    return storage.node_bits(walk(spark, sf_dir))


@query(_BITS + f""", s AS (SELECT CAST(sum(arcs) AS BIGINT) AS arcs, CAST(sum(time_bits) AS BIGINT) AS time_bits, CAST(sum(multiple_bits + interval_bits + residual_bits) AS BIGINT) AS graph_bits, sum(multiple_bits) AS am, sum(interval_bits) AS ai, sum(residual_bits) AS ar, (SELECT count(*) FROM ids) AS nodes FROM nb),
    f AS (SELECT *, CAST(nodes AS DOUBLE) * nodes AS n2, CAST(arcs AS DOUBLE) AS a FROM s)
    SELECT nodes, arcs, graph_bits, time_bits, round(graph_bits / a, 6) AS bits_per_link, round(graph_bits / CAST(nodes AS DOUBLE), 6) AS bits_per_node, round(am / CAST(nodes AS DOUBLE), 6) AS avg_multiple_bits, round(ai / CAST(nodes AS DOUBLE), 6) AS avg_interval_bits, round(ar / CAST(nodes AS DOUBLE), 6) AS avg_residual_bits,
    CASE WHEN n2 > a THEN round(graph_bits / (({_stirling('n2')} - {_stirling('a')} - {_stirling('greatest(n2 - a, 1)')}) / ln(2)), 6) END AS ratio FROM f""")
def a7_properties(spark, sf_dir):
    e = walk(spark, sf_dir)
    return storage.properties(e, walk_ids(spark, e).count())


@query(f"SELECT x, {_nat('x')} AS nat, CAST({_gamma('abs(x)')} AS BIGINT) AS gamma, CAST({_zeta('abs(x)', 2)} AS BIGINT) AS zeta2, CAST({_zeta('abs(x)', 3)} AS BIGINT) AS zeta3, abs(x) + 1 AS unary FROM (SELECT unnest(range(-300, 5000)) AS x)", "one AS (SELECT 1)")
def c1_code_lengths(spark, sf_dir):
    x = spark.range(-300, 5_000).withColumnRenamed("id", "x")
    size = F.abs("x")
    return x.select("x", codec.int2nat("x").alias("nat"), codec.gamma_bits(size).alias("gamma"), codec.zeta_bits(size, 2).alias("zeta2"), codec.zeta_bits(size, 3).alias("zeta3"), codec.unary_bits(size).alias("unary"))


_SIZE = _log("(x + 1)")


@query(f"""SELECT x, CAST({_SIZE} + {_gamma(_SIZE)} AS BIGINT) AS delta, CASE WHEN x = 0 THEN 4 ELSE 4 * ({_log('greatest(x, 1)')} // 3 + 1) END AS nibble,
    x // 6 + 1 + CASE WHEN x % 6 < 2 THEN 2 ELSE 3 END AS golomb6, x + 1 AS golomb1 FROM (SELECT unnest(range(0, 5000)) AS x)""", "one AS (SELECT 1)")
def c6_code_lengths(spark, sf_dir):
    return spark.range(5_000).select(F.col("id").alias("x"), codec.delta_bits("id").alias("delta"), codec.nibble_bits("id").alias("nibble"), codec.golomb_bits("id", 6).alias("golomb6"), codec.golomb_bits("id", 1).alias("golomb1"))


@query("SELECT n, CASE WHEN n % 2 = 0 THEN n // 2 ELSE -(n // 2) - 1 END AS x FROM (SELECT unnest(range(0, 5000)) AS n)", "one AS (SELECT 1)")
def c2_nat2int(spark, sf_dir):
    return spark.range(5_000).select(F.col("id").alias("n"), codec.nat2int("id").alias("x"))


@query("SELECT ts, ts // 3600 * 3600 AS bucket, ts // 3600 - (SELECT min(ts) FROM walk) // 3600 AS difference FROM walk")
def c7_time_buckets(spark, sf_dir):
    e = walk(spark, sf_dir)
    low = F.lit(_first(spark, e, "ts")).cast("bigint")
    return e.select("ts", codec.bucket("ts", 3_600).alias("bucket"), codec.bucket_difference(low, "ts", 3_600).alias("difference"))


@query(_ENCODED + f", b AS (SELECT src, CAST(sum({_zeta('delta', 2)}) AS BIGINT) AS bits FROM enc GROUP BY src) SELECT src, bits, CAST(64 + coalesce(sum(bits) OVER (ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM b")
def k7_offsets(spark, sf_dir):
    return storage.offsets(walk(spark, sf_dir))


@query(f", d AS (SELECT id, count(src) AS degree FROM ids LEFT JOIN walk ON src = id GROUP BY id) SELECT id, CAST({_gamma('degree')} AS BIGINT) AS bits FROM d")
def k6_degree_bits(spark, sf_dir):
    e = walk(spark, sf_dir)
    return access.out_degrees(e, walk_ids(spark, e)).select("id", codec.gamma_bits("degree").alias("bits"))


def _sweep_sql() -> str:
    parts = []
    for f in storage.SWEEP_FACTORS:
        d = _nat(f"(ts // {f} - before // {f})")
        parts += [f"SELECT CAST({k} AS BIGINT) AS k, CAST({f} AS BIGINT) AS factor, CAST(64 + sum({_zeta('d', k)}) AS BIGINT) AS time_bits FROM (SELECT {d} AS d FROM e0)" for k in storage.SWEEP_K]
    low = "CASE WHEN t >= n THEN " + _log("greatest(t // n, 1)") + " ELSE 0 END"
    return _ENCODED + ", p AS (" + " UNION ALL ".join(parts) + f"), q AS (SELECT k, factor, time_bits, time_bits AS t, (SELECT count(DISTINCT src) FROM walk) AS n FROM p) SELECT k, factor, time_bits, CAST(n * {low} + n + floor(t / pow(2.0, {low})) AS BIGINT) AS index_bits FROM q"


@query(_sweep_sql())
def p1_sweep(spark, sf_dir):
    return storage.sweep(walk(spark, sf_dir))


# Graph analytics

_START = "(SELECT min(src) FROM walk)"
_LEVELS = f""", r AS (SELECT {_START} AS id, 0 AS d UNION SELECT fc.dst, r.d + 1 FROM r JOIN fc ON fc.src = r.id WHERE r.d < (SELECT count(*) FROM ids)),
    lv AS (SELECT id, CAST(min(d) AS BIGINT) AS dist FROM r GROUP BY id)"""


@query(f"{_LEVELS} SELECT id, dist FROM lv", recursive=True)
def g1_bfs_levels(spark, sf_dir):
    e = walk(spark, sf_dir)
    return traversal.bfs(e, _first(spark, e), parents=False)


#: Queue order within a level is the order of the paths by which ids came in; a parent has the least path of those that reach.
@query(f"""{_LEVELS}, q AS (SELECT id, 0 AS d, [id] AS path, -1 AS parent, 0 AS ts FROM lv WHERE dist = 0
    UNION ALL SELECT id, d, path, parent, ts FROM (SELECT fc.dst AS id, q.d + 1 AS d, list_append(q.path, fc.dst) AS path, q.id AS parent, fc.ts AS ts,
        row_number() OVER (PARTITION BY fc.dst ORDER BY q.path) AS nth FROM q JOIN fc ON fc.src = q.id JOIN lv ON lv.id = fc.dst AND lv.dist = q.d + 1) WHERE nth = 1)
    SELECT id, CAST(d AS BIGINT) AS dist, CAST(parent AS BIGINT) AS parent, CAST(ts AS BIGINT) AS ts FROM q""", recursive=True)
def g1_bfs(spark, sf_dir):
    e = walk(spark, sf_dir)
    return traversal.bfs(e, _first(spark, e))


def _arrival_sql(table: str) -> str:
    return f""", r AS (SELECT {_START} AS id, CAST(0 AS BIGINT) AS ts UNION SELECT e.dst, e.ts FROM r JOIN {table} e ON e.src = r.id WHERE r.ts <= e.ts),
    b AS (SELECT id, min(ts) AS ts FROM r GROUP BY id)"""


def _arrival(spark, sf_dir, contacts, **options):
    e = walk(spark, sf_dir)
    return traversal.earliest_arrival(e, e.agg(F.min("src").alias("id")), contacts, **options)


@query(_arrival_sql("fc") + " SELECT id, ts FROM b", recursive=True)
def g2_earliest_arrival(spark, sf_dir):
    return _arrival(spark, sf_dir, "first")


@query(_arrival_sql("walk") + " SELECT id, ts FROM b", recursive=True)
def g2_earliest_arrival_all(spark, sf_dir):
    return _arrival(spark, sf_dir, "all")


@query(_arrival_sql("fc") + f""" SELECT b.id, b.ts, CASE WHEN b.id = {_START} THEN -1 ELSE (SELECT min(e.src) FROM fc e JOIN b s ON s.id = e.src WHERE e.dst = b.id AND e.ts = b.ts AND s.ts <= e.ts) END AS parent FROM b""", recursive=True)
def a5_arrival_parents(spark, sf_dir):
    return _arrival(spark, sf_dir, "first", parents=True)


@query(""", r AS (SELECT id, CAST(0 AS BIGINT) AS ts FROM ids UNION SELECT e.dst, e.ts FROM r JOIN fc e ON e.src = r.id WHERE r.ts <= e.ts)
    SELECT id, min(ts) AS ts FROM r GROUP BY id""", recursive=True)
def g4_temporal_reach(spark, sf_dir):
    return traversal.earliest_arrival(*_whole(spark, sf_dir))


_ROOTS = ", r AS (SELECT id AS root, id FROM ids UNION SELECT r.root, e.dst FROM r JOIN fc e ON e.src = r.id), m AS (SELECT id, min(root) AS root FROM r GROUP BY id)"
_WEAK = ", u AS (SELECT src, dst FROM fc UNION SELECT dst, src FROM fc), r AS (SELECT id AS root, id FROM ids UNION SELECT r.root, u.dst FROM r JOIN u ON u.src = r.id), m AS (SELECT id, min(root) AS root FROM r GROUP BY id)"


@query(_ROOTS + " SELECT id, root, dense_rank() OVER (ORDER BY root) - 1 AS component FROM m", recursive=True)
def g3_components(spark, sf_dir):
    return traversal.components(*_whole(spark, sf_dir))


@query(_WEAK + " SELECT id, root FROM m", recursive=True)
def g3_weak_components(spark, sf_dir):
    return traversal.weak_components(*_whole(spark, sf_dir))


@query(_WEAK + " SELECT root, count(*) AS size FROM m GROUP BY root", recursive=True)
def a11_component_sizes(spark, sf_dir):
    return traversal.component_sizes(traversal.weak_components(*_whole(spark, sf_dir)))


# Pairs that come again within an hour: a graph of many components

_BURSTS = ", g AS (SELECT DISTINCT a.src, a.dst FROM walk a JOIN walk b ON a.src = b.src AND a.dst = b.dst WHERE b.ts > a.ts AND b.ts - a.ts <= 3600)"


def _bursts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Pairs that come again within an hour, and the walk's ids."""
    e, ids = _whole(spark, sf_dir)
    after = F.lead("ts").over(Window.partitionBy("src", "dst").orderBy("ts"))
    again = e.select("src", "dst", "ts").distinct().withColumn("after", after).filter(F.col("after") - F.col("ts") <= 3600)
    return materialised(again.select("src", "dst").distinct(), "bursts"), ids


@query(_BURSTS + ", r AS (SELECT id AS root, id FROM ids UNION SELECT r.root, g.dst FROM r JOIN g ON g.src = r.id), m AS (SELECT id, min(root) AS root FROM r GROUP BY id) SELECT id, root, dense_rank() OVER (ORDER BY root) - 1 AS component FROM m", recursive=True)
def g3_burst_components(spark, sf_dir):
    return traversal.components(*_bursts(spark, sf_dir))


@query(_BURSTS + ", u AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g), r AS (SELECT id AS root, id FROM ids UNION SELECT r.root, u.dst FROM r JOIN u ON u.src = r.id) SELECT id, min(root) AS root FROM r GROUP BY id", recursive=True)
def g3_burst_weak_components(spark, sf_dir):
    return traversal.weak_components(*_bursts(spark, sf_dir))


def _rank_sql(steps: int, normalize: bool) -> str:
    sql = """, days AS (SELECT src, dst, (min(ts) - (SELECT min(ts) FROM walk)) // 86400 AS day FROM walk GROUP BY src, dst), deg AS (SELECT src, count(*) AS degree FROM walk GROUP BY src),
    n AS (SELECT count(*) AS n FROM ids), arcs AS (SELECT src, dst, 0.85::DOUBLE * (1 - exp(-0.1::DOUBLE * day)) / degree AS w FROM days JOIN deg USING (src)), r0 AS (SELECT id, 1.0::DOUBLE / n AS rank FROM ids, n)"""
    for i in range(1, steps + 1):
        sql += f", x{i} AS (SELECT id, (1 - 0.85::DOUBLE) / n + coalesce(got, 0) AS rank FROM ids CROSS JOIN n LEFT JOIN (SELECT dst, sum(w * rank) AS got FROM arcs JOIN r{i - 1} ON src = id GROUP BY dst) ON dst = id)"
        sql += f", r{i} AS (SELECT id, rank / (SELECT sum(rank) FROM x{i}) AS rank FROM x{i})" if normalize else f", r{i} AS (SELECT id, rank FROM x{i})"
    return sql


def _ranks(spark, sf_dir, normalize):
    e = walk(spark, sf_dir)
    low = _first(spark, e, "ts")
    days = e.withColumn("ts", codec.div(F.col("ts") - low, F.lit(86_400).cast("bigint")))
    return scores.page_rank(days, walk_ids(spark, e), 3, normalize=normalize)


@query(_rank_sql(3, False) + " SELECT id, round(rank, 9) AS rank FROM r3")
def g5_page_rank(spark, sf_dir):
    return _ranks(spark, sf_dir, False).select("id", F.round("rank", 9).alias("rank"))


@query(_rank_sql(3, True) + " SELECT id, round(rank, 9) AS rank FROM r3")
def g5_page_rank_normalized(spark, sf_dir):
    return _ranks(spark, sf_dir, True).select("id", F.round("rank", 9).alias("rank"))


@query(_rank_sql(3, False) + " SELECT id, round(rank, 9) AS rank FROM r3 ORDER BY round(rank, 9) DESC, id LIMIT 10")
def w2_top_ranks(spark, sf_dir):
    return scores.top_ranks(_ranks(spark, sf_dir, False).select("id", F.round("rank", 9).alias("rank")))


@query(_rank_sql(3, False) + " SELECT round(sum(rank), 6) AS total, count(*) AS ids FROM r3")
def a11_rank_sum(spark, sf_dir):
    return scores.rank_sum(_ranks(spark, sf_dir, False)).select(F.round("total", 6).alias("total"), "ids")


def _hits_sql(steps: int) -> str:
    sql = ", a0 AS (SELECT id, 1.0::DOUBLE AS s FROM ids)"
    for i in range(1, steps + 1):
        sql += f""", y{i} AS (SELECT id, coalesce(got, 0) AS s FROM ids LEFT JOIN (SELECT src, sum(s) AS got FROM fc JOIN a{i - 1} ON dst = id GROUP BY src) ON src = id), h{i} AS (SELECT id, s / (SELECT sqrt(sum(s * s)) FROM y{i}) AS s FROM y{i}),
        z{i} AS (SELECT id, coalesce(got, 0) AS s FROM ids LEFT JOIN (SELECT dst, sum(s) AS got FROM fc JOIN h{i} ON src = id GROUP BY dst) ON dst = id), a{i} AS (SELECT id, s / (SELECT sqrt(sum(s * s)) FROM z{i}) AS s FROM z{i})"""
    return sql + f" SELECT id, round(h{steps}.s, 9) AS hub, round(a{steps}.s, 9) AS authority FROM h{steps} JOIN a{steps} USING (id)"


@query(_hits_sql(3))
def g6_hits(spark, sf_dir):
    e = walk(spark, sf_dir)
    return scores.hits(e, walk_ids(spark, e), 3).select("id", F.round("hub", 9).alias("hub"), F.round("authority", 9).alias("authority"))


def _color_sql(priorities: str) -> str:
    return f""", p AS ({priorities}),
    up AS (SELECT fc.src, fc.dst FROM fc JOIN p a ON a.id = fc.src JOIN p b ON b.id = fc.dst WHERE fc.src <> fc.dst AND (b.prio > a.prio OR (b.prio = a.prio AND fc.dst < fc.src))),
    r AS (SELECT id, CAST(0 AS BIGINT) AS n FROM ids UNION SELECT up.src, r.n + 1 FROM r JOIN up ON up.dst = r.id) SELECT id, max(n) AS color FROM r GROUP BY id"""


@query(_color_sql("SELECT id, ((id * 2654435761) % 4294967296) // 16777216 AS prio FROM ids"), recursive=True)
def g8_coloring(spark, sf_dir):
    e, ids = _whole(spark, sf_dir)
    return scores.color(e, ids.select("id", scores.hash_priority().alias("priority")))


#: The sequence is that of a linear congruence modulo 2**48, begun at (123 xor its factor): each state follows from the one before.
@query(""", q AS (SELECT CAST(0 AS BIGINT) AS id, CAST(xor(123, 25214903917) AS HUGEINT) AS state UNION ALL SELECT id + 1, (state * 25214903917 + 11) % 281474976710656 FROM q WHERE id <= (SELECT max(id) FROM ids))"""
    + _color_sql("SELECT id - 1 AS id, state // 1099511627776 AS prio FROM q WHERE id > 0"), recursive=True)
def g8_coloring_sequence(spark, sf_dir):
    e, ids = _whole(spark, sf_dir)
    return scores.color(e, scores.sequence_priorities(spark, ids.count()))
