import numpy as np

from arcwise.llm import vector_index
from tests.llm import brute
from tests.llm.test_text_operators import sorted_rows

SCHEMA = "vec_id bigint, embedding array<float>, label int, kept string"


def linked(rows, cosine=0.93):
    ok = [(i, np.array(e, float), lab) for i, e, lab in rows if i is not None and lab is not None and e and all(v is not None and np.isfinite(v) for v in e) and any(e)]
    links, count = [], {}
    for n, (i, x, a) in enumerate(ok):
        for j, y, b in ok[:n]:
            if a == b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links.append((i, j))
                count[i] = count.get(i, 0) + 1
                count[j] = count.get(j, 0) + 1
    comp = brute.components({i for i, _, _ in rows}, links)
    return sorted(((i, count.get(i, 0), comp[i], comp[i] == i) for i, _, _ in rows), key=str)


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    want = linked(rows)
    assert sorted_rows(vector_index.near_duplicate_vectors(df)) == want
    return sum(n > 0 for _, n, _, _ in want)


def test_table_equals_brute_force(spark, tables):
    rows = [(r[0], r[1], r[2]) for r in spark.read.parquet(f"{tables}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    check(spark, rows)


def test_odd_vectors_and_tiles(spark, monkeypatch):
    r = np.random.default_rng(2)
    base = r.normal(size=(4, 16))
    rows = [(100 + i, (base[i % 4] + r.normal(size=16) * 0.12).astype(np.float32).tolist(), int(i % 3 == 0)) for i in range(160)]
    nan, inf = float("nan"), float("inf")
    rows += [(1, None, 1), (2, [], 1), (3, [0.0] * 16, 1), (4, [nan] * 16, 1), (5, [inf] + [1.0] * 15, 1), (6, [None] + [1.0] * 15, 1), (7, [1.0] * 16, None), (8, [1.0] * 16, 1), (9, [1.0] * 16, 1), (10, [2.0] * 16, 1), (11, [1.0] * 3, 1), (12, [1.0] * 3, 1), (13, [1.0] * 16, 0), (14, [-1.0] * 16, 1)]
    assert check(spark, rows) > 100
    monkeypatch.setattr(vector_index, "TILE", 7)
    check(spark, rows)
    df = spark.createDataFrame([(*x, "x") for x in [*rows, (None, [1.0] * 16, 1)]], SCHEMA)
    assert vector_index.near_duplicate_vectors(df).count() == len(rows) + 1
    assert vector_index.near_duplicate_vectors(df.limit(0)).count() == 0


def test_visits_are_the_nearest_cells():
    r = np.random.default_rng(3)
    index = vector_index.MultiIndex(r.normal(size=(5, 3)), r.normal(size=(7, 4)))
    x = r.normal(size=(20, 7))
    d1, d2 = index.distances(x)
    cost = (d1[:, :, None] + d2[:, None, :]).reshape(20, -1)
    for n in (1, 4, 9, 35):
        assert np.allclose(np.sort(np.take_along_axis(cost, index.visits(x, n), 1), 1), np.sort(cost, 1)[:, :n])


def test_cells_follow_from_every_query_alike(spark):
    """Few vectors have links, a hot group has nearly all of them, and the rest need more than 64 cells."""
    r = np.random.default_rng(4)
    hot = r.normal(size=16)
    x = [*(hot + r.normal(size=(60, 16)) * 0.01), *r.normal(size=(900, 16))]
    for _ in range(25):
        y = r.normal(size=16)
        x += [y, y + r.normal(size=16) * 0.6]
    rows = spark.createDataFrame([(i, v.tolist(), 1, "x") for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int, kept string")
    index = vector_index.MultiIndex(r.normal(size=(24, 8)) / 4, r.normal(size=(24, 8)) / 4)
    q = vector_index.unit(x, 16)
    link = q @ q.T >= 0.8
    np.fill_diagonal(link, False)
    order = index.visits(q, 576)
    rank = np.argsort(order, axis=1)[:, order[:, 0]]
    share = np.array([[(link[i] & (rank[i] < n)).sum() / link[i].sum() for n in range(1, 577)] for i in np.flatnonzero(link.any(axis=1))]).mean(axis=0)
    want = int(np.argmax(share >= 0.999)) + 1
    assert want > 64
    reps = vector_index._clean(rows, "vec_id", "embedding", "label")
    for queries in (5, 5000):
        n, got = vector_index.cells_for(reps, index, 0.8, 0.999, queries)
        assert n == want and abs(got - share[n - 1]) < 1e-9
