"""Every registered query against its SQL in DuckDB, or at least that it runs."""

import math
import os

import duckdb
import pytest

from arcwise.plans import catalog

TABLES = ("orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(tables, t)}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 9) if isinstance(v, float) else bytes(v) if isinstance(v, bytearray) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, tables, duck, name):
    df = catalog.QUERIES[name](spark, tables)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name in catalog.ORACLES:
        cursor = duck.execute(catalog.ORACLES[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        want = [tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in cursor.fetchall()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_whole_walk_equals_plain_python(spark, tables):
    """The loops without SQL, on all edges of the walk."""
    edges = {(r["src"], r["dst"]) for r in catalog.walk(spark, tables).collect()}
    out, both, top = {}, {}, max(max(e) for e in edges)
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        both.setdefault(a, set()).add(b)
        both.setdefault(b, set()).add(a)

    def reached(start, links):
        dist, front = {start: 0}, [start]
        for x in front:
            for y in links.get(x, ()):
                if y not in dist:
                    dist[y] = dist[x] + 1
                    front.append(y)
        return dist

    def least(links):
        root = {}
        for i in range(top + 1):
            for x in reached(i, links) if i not in root else ():
                root.setdefault(x, i)
        return root

    bfs = {r["id"]: r["dist"] for r in catalog.QUERIES["g1_bfs"](spark, tables).collect()}
    assert bfs == reached(min(out), out) and len(bfs) > 10
    for name, links in (("g3_components", out), ("g3_weak_components", both)):
        assert {r["id"]: r["root"] for r in catalog.QUERIES[name](spark, tables).collect()} == least(links)
    ids = range(top + 1)
    priority = {i: ((i * 2654435761) % 4294967296) // 16777216 for i in ids}
    color = {}
    for i in sorted(ids, key=lambda i: (-priority[i], i)):
        color[i] = max([color[j] + 1 for j in out.get(i, ()) if j != i and (-priority[j], j) < (-priority[i], i)], default=0)
    assert {r["id"]: r["color"] for r in catalog.QUERIES["g8_coloring"](spark, tables).collect()} == color
