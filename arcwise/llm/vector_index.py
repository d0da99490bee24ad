"""Embedding near-dedup with an inverted multi-index.

Vectors are scaled to length one and cut into halves; a codebook for each half is fitted on a bounded sample
(``sample`` vectors of least hash), and pairs of codewords form a grid of cells. Each vector stands in the
cell of its nearest codewords and visits the cells that the multi-sequence order of its distances gives, the
nearest first. How many it visits follows from sampled vectors that are compared with all rows by brute force: the
least number with which a vector that has links finds ``recall`` of them on average, each vector with equal weight.
Vectors are sampled until ``LINKED`` of them have links, or all were asked; the number of cells has no bound but the
grid. Pairs that meet are verified by cosine in double precision.

Codebooks grow with the root of the number of vectors, so that a cell holds about ``FILL`` of them. Every row is indexed. Vectors with equal label and components are one vector with a count. Cells with more than
``TILE`` vectors are dealt into tiles; a visitor goes to all tiles of a cell. A tile gives counts and a
spanning forest of its links, never pairs, so a large group of near copies costs comparisons in blocks only.

Only vectors of equal, non-null label and equal length are compared. Vectors that are null, zero or hold null or
non-finite components link with nothing. Rows that repeat a vec_id count as vectors of their own and share
a node; null ids link with nothing. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arcwise.llm.shared import in_batches, least_hashed, prepared, written
from arcwise.operators.traversal import connected_components

COSINE = 0.93
SAMPLE = 20_000
#: Vectors asked in the first round; each round asks four times as many as the one before, up to ROUND.
QUERIES = 1_000
ROUND = 16_000
#: Distances to codewords that a round's queries, or a batch's vectors, have at most.
_DISTANCES = 8_000_000
#: Asked vectors with links that are enough: if all find theirs, recall is 0.99 or more at a confidence of 0.95.
LINKED = 300
RECALL = 0.999
TILE = 2_000
#: Vectors that a cell is to hold, and codewords of a half at least and at most.
FILL, WORDS = 200, (4, 2_048)


def vectors_of(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list column as arrays of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))]
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def unit(rows: list[np.ndarray], size: int) -> np.ndarray:
    """Rows of length one, cut or filled up to the size of the codebooks: only cells depend on that."""
    out = np.zeros((len(rows), size))
    for i, x in enumerate(rows):
        out[i, : min(size, len(x))] = x[:size] / np.sqrt(x @ x)
    return out


def codebook(points: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """k codewords by Lloyd's rounds from random points."""
    r = np.random.default_rng(seed)
    words = points[r.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        near = (np.sum(words * words, axis=1) - 2 * points @ words.T).argmin(axis=1)
        many = np.bincount(near, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, near, points)
        words[many > 0] = sums[many > 0] / many[many > 0, None]
    return words


@dataclass
class MultiIndex:
    first: np.ndarray
    second: np.ndarray

    @property
    def size(self) -> int:
        return self.first.shape[1] + self.second.shape[1]

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        return tuple(np.sum(c * c, axis=1) - 2 * p @ c.T for p, c in ((x[:, :cut], self.first), (x[:, cut:], self.second)))

    def visits(self, x: np.ndarray, cells: int) -> np.ndarray:
        """The first ``cells`` cells of each row's multi-sequence: pairs of ranks (i, j) with (i + 1)(j + 1) <= cells hold them."""
        d1, d2 = self.distances(x)
        o1, o2 = (np.argsort(d, axis=1, kind="stable") for d in (d1, d2))
        ranks = [(i, j) for i in range(min(cells, d1.shape[1])) for j in range(min(cells // (i + 1), d2.shape[1]))]
        i, j = np.array(ranks).T
        cost = np.take_along_axis(d1, o1[:, i], 1) + np.take_along_axis(d2, o2[:, j], 1)
        cell = o1[:, i] * d2.shape[1] + o2[:, j]
        best = np.argsort(cost, axis=1, kind="stable")[:, :cells]
        return np.take_along_axis(cell, best, 1)


def _clean(vectors: DataFrame, key: str, embedding: str, label: str) -> DataFrame:
    """The vectors that can link, each once with its least id and the number of rows."""
    x = F.col("embedding")
    # Floats go as they are: a double has their value. Other numbers become doubles.
    given = F.col(f"`{embedding}`")
    if vectors.schema[embedding].dataType.simpleString() != "array<float>":
        given = given.cast("array<double>")
    rows = vectors.select(F.col(f"`{key}`").cast("bigint").alias("vec"), F.col(f"`{label}`").alias("label"), given.alias("embedding"))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    rows = rows.filter(F.col("vec").isNotNull() & F.col("label").isNotNull() & x.isNotNull()).filter(sound)
    return rows.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(1), "embedding"))


def fit(rows: DataFrame, total: int, sample: int = SAMPLE) -> MultiIndex | None:
    """Codebooks of a bounded sample; their size follows the number of vectors."""
    own = [np.array(r[0], float) for r in least_hashed(rows.select("vec", "embedding"), sample, "vec").select("embedding").collect()]
    if not own:
        return None
    size = int(np.bincount([len(x) for x in own]).argmax())
    points = unit(own, size)
    k = int(np.clip(np.ceil((total / FILL) ** 0.5), *WORDS))
    return MultiIndex(codebook(points[:, : size // 2], k), codebook(points[:, size // 2 :], k, seed=2))


def _asked(rows: DataFrame, index: MultiIndex, low: float, high: float, cosine: float) -> tuple[DataFrame, int]:
    """((query, rank, n): on how many links of a query is the other's home at a rank of its visits; number of queries), for the vectors whose place by hash is in [low, high)."""
    place = F.pmod(F.xxhash64("label", "vec", "h1", "h2"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    asked = rows.filter((place >= low) & (place < high)).select("vec", "label", "embedding").collect()  # ROUND vectors on average at most
    own = [np.array(r["embedding"], float) for r in asked]
    kinds: dict = {}
    for i, r in enumerate(asked):
        kinds.setdefault((r["label"], len(own[i])), []).append(i)
    vec = np.array([r["vec"] for r in asked], np.int64)
    groups = {k: (np.array(i), vec[i], np.stack([own[j] / np.sqrt(own[j] @ own[j]) for j in i])) for k, i in kinds.items()}
    sent = rows.sparkSession.sparkContext.broadcast((index, index.distances(unit(own, index.size)), groups))

    def run(batches):
        index, (d1, d2), groups = sent.value
        cells, order2 = len(index.first) * len(index.second), np.sort(d2, axis=1)
        for batch in batches:
            xs, labels, vec = vectors_of(batch.column("embedding")), batch.column("label").to_pylist(), batch.column("vec").to_numpy()
            home = index.visits(unit(xs, index.size), 1)[:, 0]
            kinds: dict = {}
            for i, x in enumerate(xs):
                if (k := (labels[i], len(x))) in groups:
                    kinds.setdefault(k, []).append(i)
            met = [np.zeros(0, np.int64)]
            for k, i in kinds.items():
                which, ids, q = groups[k]
                x, i = np.stack([xs[j] / np.sqrt(xs[j] @ xs[j]) for j in i]).T, np.array(i)
                for at in range(0, len(q), 500):
                    a, b = np.nonzero(q[at : at + 500] @ x >= cosine)
                    other = ids[at + a] != vec[i[b]]
                    met.append(which[at + a[other]] * cells + home[i[b[other]]])
            pair, n = np.unique(np.concatenate(met), return_counts=True)
            query, cell = pair // cells, pair % cells
            rank = np.empty(len(pair), np.int64)
            for i, (q, c) in enumerate(zip(query.tolist(), cell.tolist(), strict=True)):
                # Cells that are no farther than this one, by the second half's distances in order.
                cost = d1[q, c // len(index.second)] + d2[q, c % len(index.second)] + 1e-12
                rank[i] = max(int(np.searchsorted(order2[q], cost - d1[q], "right").sum()) - 1, 0)
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(rank), pa.array(n.astype(np.int64))], names=["query", "rank", "n"])

    return rows.select("vec", "label", "embedding").transform(in_batches, run, "query bigint, rank bigint, n bigint").groupBy("query", "rank").agg(F.sum("n").alias("n")), len(asked)


def cells_for(rows: DataFrame, index: MultiIndex, cosine: float, recall: float, queries: int = QUERIES, linked: int = LINKED) -> tuple[int, float]:
    """(cells to visit, average share of its links that a sampled vector with links finds with them), by brute force over all rows."""
    total, cells = max(rows.count(), 1), len(index.first) * len(index.second)
    found, some, low, size = np.zeros(cells), 0.0, 0.0, queries
    while low < 1 and some < linked:
        high = low + size / total
        got, asked = _asked(rows, index, low, high, cosine)
        if asked:
            of = got.groupBy("query").agg(F.sum("n").alias("all"))
            for r in got.join(of, "query").groupBy("rank").agg(F.sum(F.col("n") / F.col("all")).alias("share")).collect():  # a row for each rank
                found[r["rank"]] += r["share"]
        some, low, size = found.sum() + 1e-6, high, min(size * 4, ROUND, _DISTANCES // len(index.first))
    if not found.any():
        return 4, 1.0  # all were asked, and none has links
    share = np.cumsum(found) / found.sum()
    n = min(max(4, int(np.argmax(share >= min(recall, 1 - 1e-9))) + 1), cells)
    return n, float(share[n - 1])


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes, the least node that the links (a, b) reach."""
    low = np.arange(n)
    while True:
        before = low.copy()
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
        low = low[low]
        if np.array_equal(low, before):
            return low


def near_duplicate_vectors(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """(key, n_links, component_id, kept) for every row."""
    spark = prepared(vectors.sparkSession)
    rows = _clean(vectors, key, embedding, label)
    reps = written(rows.groupBy("label", "h1", "h2").agg(F.min("vec").alias("vec"), F.count("*").alias("rows"), F.first("embedding").alias("embedding")), "vectors")
    total = reps.count()
    index = fit(reps, total, sample)
    everyone = vectors.select(F.col(key).cast("bigint").alias("vec"))
    if index is None:
        return everyone.select(F.col("vec").alias(key), F.lit(0).cast("bigint").alias("n_links"), F.col("vec").alias("component_id"), F.lit(True).alias("kept"))
    cells, _ = cells_for(reps, index, cosine, recall)
    grid = len(index.first) * len(index.second)
    sent = spark.sparkContext.broadcast(index)

    def place(batches):
        step = _DISTANCES // 4 // len(sent.value.first)
        for batch in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
            xs = vectors_of(batch.column("embedding"))
            visits = sent.value.visits(unit(xs, sent.value.size), cells)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, visits.size + 1, visits.shape[1]), pa.int32()), pa.array(visits.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("vec"), batch.column("label"), pa.array([len(x) for x in xs], pa.int32()), batch.column("rows"), batch.column("embedding"), flat], names=["vec", "label", "size", "rows", "embedding", "visits"])

    kind, number = (reps.schema[c].dataType.simpleString() for c in ("label", "embedding"))
    placed = reps.select("vec", "label", "rows", "embedding").transform(in_batches, place, f"vec bigint, label {kind}, size int, rows bigint, embedding {number}, visits array<int>")
    placed = written(placed.withColumn("home", F.element_at("visits", 1)), "placed", 0)
    spread = placed.groupBy("label", "size", "home").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).withColumnRenamed("home", "cell")
    home = placed.withColumn("cell", F.col("home")).join(spread, ["label", "size", "cell"]).withColumn("tile", F.pmod(F.xxhash64("vec"), F.col("tiles")).cast("int"))
    # A visitor's own cell is among those it visits.
    visitor = placed.withColumn("cell", F.explode("visits")).join(spread, ["label", "size", "cell"]).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    # Visitors of a tile are dealt too, so that a task holds TILE of each at most on average.
    crowd = visitor.groupBy("label", "size", "cell").agg(F.ceil(F.countDistinct("vec") / TILE).cast("int").alias("parts"))
    # Only a tile's own vectors bring what they visit along.
    columns = ["label", "size", "cell", "tile", "part", "vec", "rows", "embedding", "home"]
    home = home.join(crowd, ["label", "size", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*columns, "visits", F.lit(True).alias("owner"))
    visitor = visitor.join(crowd, ["label", "size", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec", F.lit(3)), F.col("parts")).cast("int")).select(*columns, F.lit(None).cast("array<int>").alias("visits"), F.lit(False).alias("owner"))

    def tile(table):
        owner = table.column("owner").to_numpy(zero_copy_only=False)
        if owner.all() or not owner.any():
            return pa.Table.from_pydict({"vec": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        x = np.stack(vectors_of(table.column("embedding").combine_chunks()))
        x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        vec, rows, home = (table.column(c).to_numpy() for c in ("vec", "rows", "home"))
        lists = table.column("visits").combine_chunks()
        many = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        seen = np.sort(np.repeat(np.arange(len(vec)), many) * grid + lists.flatten().to_numpy(zero_copy_only=False))
        ids, node = np.unique(vec, return_inverse=True)
        links, low = np.zeros(len(ids), np.int64), np.arange(len(ids))
        own, guests = np.flatnonzero(owner), np.flatnonzero(~owner)
        for a in range(0, len(guests), 512):
            g = guests[a : a + 512]
            i, j = np.nonzero(x[g] @ x[own].T >= cosine)
            i, j = g[i], own[j]
            ok = vec[i] != vec[j]
            i, j = i[ok], j[ok]
            np.add.at(links, node[i], rows[j])
            # A pair of which only one visits the other counts for both.
            key = j * grid + home[i]
            one = seen[np.minimum(np.searchsorted(seen, key), len(seen) - 1)] != key
            np.add.at(links, node[j[one]], rows[i[one]])
            low = _forest(len(ids), np.concatenate([node[i], np.arange(len(ids))]), np.concatenate([node[j], low]))
        some = (links > 0) | (low != np.arange(len(ids)))
        return pa.Table.from_pydict({"vec": ids[some], "links": links[some], "root": ids[low[some]]})

    found = home.unionByName(visitor).groupBy("label", "size", "cell", "tile", "part").applyInArrow(tile, "vec bigint, links bigint, root bigint")
    found = written(found, "found", 0)
    links = found.groupBy("vec").agg(F.sum("links").alias("links"))
    component = connected_components(found.select(F.col("vec").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("vec"), "component")
    # Links of the representatives; a vector's copies are its links too. Ids on several rows share a node.
    known = reps.join(links, "vec", "left").join(component, "vec", "left")
    known = known.select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("links"), F.coalesce("component", "vec").alias("component"))
    own = rows.select("vec", "label", "h1", "h2").join(known, ["label", "h1", "h2"]).groupBy("vec").agg(F.max("links").alias("links"), F.min("component").alias("component"))
    out = everyone.join(own, "vec", "left").select("vec", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec").alias("component_id"))
    return out.select(F.col("vec").alias(key), F.col("n_links").cast("bigint"), "component_id", F.coalesce(F.col("vec") == F.col("component_id"), F.lit(True)).alias("kept"))
