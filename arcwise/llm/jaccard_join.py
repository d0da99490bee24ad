"""N-gram Jaccard join: sets of word shingles linked at a similarity, exactly, with component ids.

A document's set has the hashes (64 bits) of its runs of ``size`` words. Items are ordered by rarity, from
counters over the whole corpus. Two sets of the wanted similarity share one of their rarest items, so
each document names these, each a tile key with the document's size. In a tile, documents stand
in size bands: sizes outside a band can't reach the similarity. Of documents that meet in tiles, hashed
bitmap signatures are compared: the bits in which they differ bound the overlap from above. What is left is
decided by exact intersection of the sorted arrays.

Work stays in proportion to links: sets that are equal meet by their signature; in each tile a
document is first compared with the smallest set of its band (a star), whatever the number of near copies;
after that only documents of different components are compared, and of these each names just its nearest
in a tile, in two rounds; then all pairs that are left are compared.
Broadcast are the counters' levels (4 MB) and Bloom filters (1 MB), whose size doesn't grow.

Null, empty and wordless texts have the empty set and link with nothing. Rows that repeat a doc_id are
one node, with the links of each of its texts; each row is returned with its own set size. Null doc_ids
have null components. Very long texts count whole. Equal texts link. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arcwise.llm import packed
from arcwise.llm.blocks import U64, WORD_SPACE, bit_count, chunks, mix, text_bytes, window_hashes, word_hashes, words
from arcwise.llm.shared import discarded, few_files, in_batches, prepared, swept, written
from arcwise.operators.traversal import connected_components

SIZE = 4
SHARE = 85
_RECORD = np.dtype([("token", "<u8"), ("doc", "<i8"), ("n", "<i4")])
_MOST_BITS = 1 << 16
#: Rows, pairs, and words of signatures that a tile's comparison holds at once.
_ROWS, _PAIRS, _WORDS = 20_000, 1_000_000, 4_000_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int):
    """The sorted distinct shingle hashes of each row."""
    starts, ends, first = words(data, offsets, WORD_SPACE)
    h, at = window_hashes(word_hashes(data, starts, ends), first, size)
    for a, b in zip(at[:-1], at[1:], strict=True):
        x = np.sort(h[a:b])
        yield x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def least_overlap(n, m, share: int):
    """Least overlap of sets of n and m items whose similarity is share hundredths."""
    return -(-share * (n + m) // (100 + share))


def bitmap(items: np.ndarray) -> bytes:
    """Parities of the items that fall on each of 2**k bits, about two bits an item."""
    bits = min(max(64, 1 << int(2 * len(items) - 1).bit_length() if len(items) else 64), _MOST_BITS)
    return np.packbits(np.bincount((items & U64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Bits that differ: no more than the items that one set has and the other lacks. The longer signature is folded."""
    a, b = np.frombuffer(x, U64), np.frombuffer(y, U64)
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(bit_count(a ^ b).sum())


def _batches(batches, text: str):
    for batch in batches:
        data, offsets = text_bytes(batch.column(text))
        for a, b in chunks(offsets):
            yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _levels(docs: DataFrame, size: int) -> np.ndarray:
    def run(batches):
        from pyspark import TaskContext

        sketch = packed.Sketch()
        for _, data, offsets in _batches(batches, "text"):
            if got := [s for s in shingle_sets(data, offsets, size) if len(s)]:
                sketch.add(np.concatenate(got))
        yield sketch.batch(TaskContext.get().partitionId())

    source = docs.select("text")
    return packed.levels(source.transform(in_batches, run, packed.SKETCH_SCHEMA), source.rdd.getNumPartitions())


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """(doc, n, s1, s2, bits): of every row with a set, its size, a 128-bit signature of the set, and the bitmap."""

    def run(batches):
        for batch, data, offsets in _batches(batches, "text"):
            n, s1, s2, bits = [], [], [], []
            for s in shingle_sets(data, offsets, size):
                n.append(len(s))
                m = mix(s + U64(0x632BE59BD9B4E019))
                s1.append(int(np.bitwise_xor.reduce(m).astype(np.int64)) if len(s) else 0)
                s2.append(int(m.sum(dtype=U64).astype(np.int64)) if len(s) else 0)
                bits.append(bitmap(s))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(bits, pa.binary())], names=["doc", "n", "s1", "s2", "bits"])

    return docs.select("doc", "text").transform(in_batches, run, "doc bigint, n bigint, s1 bigint, s2 bigint, bits binary")


def _rarest(docs: DataFrame, table, size: int, share: int) -> DataFrame:
    """Packed (token, doc, n) of the rarest items, of which similar sets share one. Of equal sets in a task only the first is named."""
    buckets = packed.buckets_of(docs.sparkSession)

    def run(batches):
        seen = set()
        for batch, data, offsets in _batches(batches, "text"):
            tokens, ids, sizes = [], [], []
            if len(seen) > 100_000:
                seen.clear()
            for doc, s in zip(batch.column("doc").to_pylist(), shingle_sets(data, offsets, size), strict=True):
                if not len(s) or doc is None or (key := (len(s), int(s[0]), int(s.sum(dtype=U64)), int(np.bitwise_xor.reduce(mix(s))))) in seen:
                    continue
                seen.add(key)
                p = len(s) - -(-share * len(s) // 100) + 1
                k = packed.rarity_keys(table.value, s)
                tokens.append(np.partition(k, p - 1)[:p] if p < len(k) else k)
                ids.append(doc)
                sizes.append((p, len(s)))
            out = np.empty(sum(p for p, _ in sizes), _RECORD)
            if len(out):
                out["token"] = np.concatenate(tokens)
                out["doc"] = np.repeat(ids, [p for p, _ in sizes])
                out["n"] = np.repeat([n for _, n in sizes], [p for p, _ in sizes])
            yield packed.packed(mix(out["token"].copy()), out, buckets)

    return docs.select("doc", "text").transform(in_batches, run, "bucket int, block binary")


def _tiles(rows: DataFrame, share: int) -> DataFrame:
    """(token, doc, n, lead, many) of tokens that two documents or more name; lead: the tile's smallest set in the document's size band."""

    def work(r):
        r = r[np.lexsort((r["doc"], r["n"], r["token"]))]
        new = np.r_[True, r["token"][1:] != r["token"][:-1]]
        at = np.flatnonzero(new)
        many = np.diff(np.r_[at, len(r)])
        keep = np.repeat(many > 1, many)
        r, new, many = r[keep], new[keep], np.repeat(many, many)[keep]
        if not len(r):
            return
        # The first row of the token whose size the row's own allows: rows of a token stand by size.
        group = np.cumsum(new) - 1
        least = -(-share * r["n"].astype(np.int64) // 100)
        place = np.searchsorted((group << 32) + r["n"], (group << 32) + least)
        yield pa.RecordBatch.from_arrays([pa.array(r["token"].view(np.int64)), pa.array(r["doc"]), pa.array(r["n"].astype(np.int64)), pa.array(r["doc"][place]), pa.array(many.astype(np.int64))], names=["token", "doc", "n", "lead", "many"])

    return packed.by_bucket(rows, work, _RECORD, "token bigint, doc bigint, n bigint, lead bigint, many bigint")


def _folded(rows: np.ndarray, words: int) -> np.ndarray:
    """Signatures, one a row, folded to so many words."""
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def _nearest(rows, apart):
    """Places at which each row has its least distance."""
    order = np.lexsort((apart, rows))
    return order[np.r_[True, rows[order][1:] != rows[order][:-1]]] if len(rows) else order


def _crossing(doc, n, component, group, bits, share: int, nearest: bool):
    """Pairs (a, b) of rows of one group and different components that sizes and signatures leave, or of these each row's nearest. Rows stand by group and size."""
    words = np.array([len(x) // 8 for x in bits])
    place, tables = np.zeros(len(bits), np.int64), {}
    for w in np.unique(words):
        own = np.flatnonzero(words == w)
        place[own] = np.arange(len(own))
        tables[w] = np.frombuffer(b"".join(bits[i] for i in own), U64).reshape(-1, w)
    stop = np.searchsorted((group << 32) + n, (group << 32) + n * 100 // share, "right")
    count = np.maximum(stop - np.arange(len(n)) - 1, 0)
    total = np.cumsum(count)
    i0 = 0
    while i0 < len(n):
        i1 = max(i0 + 1, int(np.searchsorted(total, (total[i0 - 1] if i0 else 0) + _PAIRS, "right")))
        c = count[i0:i1]
        i = np.repeat(np.arange(i0, i1), c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        i0 = i1
        ok = component[i] != component[j]
        i, j = i[ok], j[ok]
        kinds = words[i] * (1 << 20) + words[j]
        for kind in np.unique(kinds):
            low, high = int(kind >> 20), int(kind & ((1 << 20) - 1))
            x, y = tables[low], tables[high]
            low = min(low, high)
            x, y = _folded(x, low), _folded(y, low)
            own = np.flatnonzero(kinds == kind)
            step = max(1, _WORDS // low)
            for s in range(0, len(own), step):
                a, b = i[own[s : s + step]], j[own[s : s + step]]
                apart = bit_count(x[place[a]] ^ y[place[b]]).sum(axis=1, dtype=np.int64)
                near = np.flatnonzero((n[a] + n[b] - apart) // 2 >= least_overlap(n[a], n[b], share))
                if nearest:
                    near = near[np.union1d(_nearest(a[near], apart[near]), _nearest(b[near], apart[near]))]
                yield np.minimum(doc[a[near]], doc[b[near]]), np.maximum(doc[a[near]], doc[b[near]])


def _across(rows: DataFrame, share: int, nearest: bool) -> DataFrame:
    """(a, b) of tiles' documents that are in different components and may be similar, by signatures in blocks; no other pair leaves a tile."""

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            token = held.column("token").to_numpy()
            whole = int(np.searchsorted(token, token[-1], "left")) if len(token) else 0
            if whole >= _ROWS:
                yield from pairs(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None:
            yield from pairs(held)

    def pairs(table):
        if not table.num_rows:
            return
        token, doc, n, component = (table.column(c).to_numpy() for c in ("token", "doc", "n", "component"))
        group = np.cumsum(np.r_[True, token[1:] != token[:-1]])
        for a, b in _crossing(doc, n, component, group, table.column("bits").to_pylist(), share, nearest):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "token").sortWithinPartitions("token", "n").transform(in_batches, run, "a bigint, b bigint")


def _verified(pairs: DataFrame, signed: DataFrame, docs: DataFrame, size: int, share: int) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity; pairs of equal sets are left out, as they are links already."""
    spark = pairs.sparkSession
    light = signed.select("doc", "n", "s1", "s2", "bits")
    named = lambda side: light.select(*[F.col(c).alias(f"{c}_{side}") for c in light.columns])
    both = pairs.join(named("a"), F.col("a") == F.col("doc_a")).join(named("b"), F.col("b") == F.col("doc_b"))
    both = both.filter("not (s1_a = s1_b and s2_a = s2_b and n_a = n_b) and n_a > 0 and n_b > 0").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")

    def bounded(batches):
        for batch in batches:
            n, m = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            apart = np.array([differing(x, y) for x, y in zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist(), strict=True)], np.int64)
            ok = pa.array((n + m - apart) // 2 >= least_overlap(n, m, share))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])

    left = written(both.transform(in_batches, bounded, "a bigint, b bigint").distinct(), "pairs")
    swept(spark)  # the exchanges of signatures
    wanted = spark.sparkContext.broadcast(packed.bloom(left.select(F.col("a").alias("doc")).unionByName(left.select(F.col("b").alias("doc"))), "doc"))

    def sets(batches):
        for batch, data, offsets in _batches(batches, "text"):
            hit = packed.bloom_has(wanted.value, batch.column("hash").to_numpy())
            if not hit.any():
                continue
            rows = np.flatnonzero(hit)
            # Only the rows that are asked for are cut into words.
            part = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in rows])
            at = np.r_[0, np.cumsum(offsets[rows + 1] - offsets[rows])]
            got = [s.tobytes() for s in shingle_sets(part, at, size)]
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(rows)), pa.array(got, pa.binary())], names=["doc", "items"])

    own = docs.filter("doc is not null").select("doc", "text", F.xxhash64("doc").alias("hash")).transform(in_batches, sets, "doc bigint, items binary")
    full = left.join(own.select(F.col("doc").alias("a"), F.col("items").alias("x")), "a").join(own.select(F.col("doc").alias("b"), F.col("items").alias("y")), "b")

    def exact(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both = np.sort(np.concatenate([x, y]))
                keep.append(np.count_nonzero(both[1:] == both[:-1]) >= least_overlap(len(x), len(y), share))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])

    links = written(full.select("a", "b", "x", "y").transform(in_batches, exact, "a bigint, b bigint").distinct(), "links")
    discarded(left)
    wanted.destroy()
    swept(spark)  # the exchanges of sets
    return links


def shingle_components(docs: DataFrame, doc: str = "doc_id", text: str = "text", size: int = SIZE, share: int = SHARE) -> DataFrame:
    """(doc id, n_shingles, component_id: least id that links reach, the row's own included), a row for every row of docs."""
    spark = prepared(docs.sparkSession)
    source = docs.select(F.col(f"`{doc}`").cast("bigint").alias("doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    table = spark.sparkContext.broadcast(_levels(source, size))
    signed = written(_signed(few_files(source, source), size), "signatures", 0)
    tiles = written(_tiles(_rarest(source, table, size, share), share), "tiles", 0)
    swept(spark)
    some = signed.filter("n > 0 and doc is not null")
    same = some.groupBy("n", "s1", "s2").agg(F.min("doc").alias("b"), F.count("*").alias("k")).filter("k > 1")
    copies = some.join(same, ["n", "s1", "s2"]).filter("doc != b").select(F.col("doc").alias("a"), "b")
    stars = written(tiles.filter("doc != lead").select(F.least("doc", "lead").alias("a"), F.greatest("doc", "lead").alias("b")).distinct(), "pairs")
    swept(spark)
    near = _verified(stars, some, source, size, share)
    links = written(copies.unionByName(near).distinct(), "links")
    discarded(near)
    first = written(connected_components(links), "components")
    swept(spark)

    # Tiles of three documents or more that still hold different components; where two meet, the star has compared them.
    tested, rest, stored = stars, tiles.filter("many > 2").select("token", "doc", "n"), tiles
    for nearest in (True, True, False):
        known = rest.join(first.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        mixed = known.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("token")
        known = written(known.join(mixed, "token"), "open")
        discarded(stored)  # what is still open is read from here on
        rest, stored = known.select("token", "doc", "n"), known
        swept(spark)
        signs = known.join(some.select("doc", F.col("n").alias("size"), "bits"), "doc").filter("n = size").select("token", "doc", "n", "component", "bits")
        pairs = written(_across(signs, share, nearest).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        swept(spark)  # the exchange of the tiles' signatures
        more = _verified(pairs, some, source, size, share)
        if not more.isEmpty():
            had = links, first, more
            links = written(links.unionByName(more), "links")
            first = written(connected_components(links), "components")
            discarded(*had)
        tested = tested.unionByName(pairs)
        swept(spark)
    ids = signed.select(F.col("doc").alias("node"), F.col("n").alias("n_shingles")).join(first, "node", "left")
    return few_files(ids.select(F.col("node").alias(doc), "n_shingles", F.coalesce("component", "node").alias("component_id")), source)
