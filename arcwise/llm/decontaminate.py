"""Benchmark decontamination: Wu-Manber multi-pattern search for word windows of benchmark items.

Symbols are words (runs of digits, letters and bytes from 0x80, A-Z as a-z), so a match is aligned
to words by construction. Patterns are the windows of ``window`` consecutive words of each item;
an item of fewer words is one shorter pattern. Patterns of one length are searched together: a
table over hashed blocks of ``BLOCK`` words holds how far the window may move; where that is nought, the hash of
the window's last block selects the patterns, and these are compared with the text word by word, byte by byte.
Many segments of text move through the table in step, so the scan is a few numpy calls per move.

Tables are broadcast, so their size is bounded: by ``table_bytes`` of what a group of items takes in them. A larger
benchmark is dealt into groups below that size, each scanned on its own, and the spans found are merged by document.

Null or wordless texts have no words, no hits and are clean. Null items' texts and items without words
have no windows. Repeated items all count, by their own id; hits of items without id count, and stand as null among the
item ids. Repeated documents are judged each on its own. Very long texts are scanned whole. Empty tables: nothing is
hit. Other columns are kept; output columns replace namesakes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from arcwise.llm.blocks import U64, WORD_ALNUM, chunks, lowered, mix, same_words, text_bytes, window_hashes, word_hashes, words
from arcwise.llm.shared import free_names, in_batches, prepared

WINDOW = 13
BLOCK = 3
#: Bytes of a group's tables, and what they hold for each word besides its text.
TABLE_BYTES, WORD_BYTES = 32_000_000, 48
#: Slots of a shift table: eight or more for each block.
_SLOT_BITS = range(12, 25)
#: Window starts that one lane covers.
_LANE = 256


class Items:
    """Words of benchmark items: bytes, places and hashes, and whose they are."""

    def __init__(self, rows: list[tuple[str | None, str | None]]):
        data, offsets = text_bytes(pa.array([t or "" for _, t in rows], pa.large_string()))
        self.data = lowered(data)
        self.starts, self.ends, self.first = words(data, offsets, WORD_ALNUM)
        self.hashes = word_hashes(data, self.starts, self.ends)
        self.ids = [i for i, _ in rows]


class Patterns:
    """The windows of one length that begin at the given words, with shift table and suffix-hash buckets."""

    def __init__(self, length: int, items: Items, starts: np.ndarray):
        self.length, self.block, self.items = length, min(BLOCK, length), items
        blocks = self.blocks(items.hashes)
        self.bits = next((b for b in _SLOT_BITS if 1 << b >= 8 * len(starts)), _SLOT_BITS[-1])
        self.shift = np.full(1 << self.bits, length - self.block + 1, np.uint8 if length < 255 else np.int32)
        for j in range(self.block - 1, length):
            np.minimum.at(self.shift, self.slots(blocks[starts + j]), length - 1 - j)
        last = blocks[starts + length - 1]
        order = np.argsort(last, kind="stable")
        self.suffix, self.starts = last[order], starts[order]

    def blocks(self, h: np.ndarray) -> np.ndarray:
        """Hash of the block that ends at each word; the first words' have no predecessors."""
        out = h.copy()
        for j in range(1, self.block):
            out[j:] = mix((out[j:] << U64(29) | out[j:] >> U64(35)) ^ h[: len(h) - j])
        return out

    def slots(self, blocks: np.ndarray) -> np.ndarray:
        return (blocks >> U64(64 - self.bits)).astype(np.int64)

    def search(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start word, number of the item) of every occurrence in the rows' words."""
        m = self.length
        count = np.maximum(np.diff(first) - m + 1, 0)
        lanes = -(-count // _LANE)
        row = np.repeat(np.arange(len(count)), lanes)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = first[row] + nth * _LANE
        stop = np.minimum(at + _LANE, first[row] + count[row])
        blocks = self.blocks(h)
        moves = self.shift[self.slots(blocks)].astype(np.int64)
        found = []
        while len(at):
            move = moves[at + m - 1]
            found.append(at[move == 0])
            at = at + np.maximum(move, 1)
            if not (live := at < stop).all():
                at, stop = at[live], stop[live]
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        low_, high = (np.searchsorted(self.suffix, blocks[at + m - 1], side) for side in ("left", "right"))
        place = np.repeat(at, high - low_)
        begun = self.starts[np.repeat(low_ - np.cumsum(high - low_) + high - low_, high - low_) + np.arange(len(place))]
        own = self.items
        # Hashes first, as they are cheap; what is left is compared byte by byte.
        for j in range(m):
            same = h[place + j] == own.hashes[begun + j]
            place, begun = place[same], begun[same]
        for j in range(m):
            p, q = place + j, begun + j
            same = same_words(low, starts[p], ends[p], own.data, own.starts[q], own.ends[q])
            if not same.all():
                place, begun = place[same], begun[same]
        return place, np.searchsorted(own.first, begun, "right") - 1


def patterns_of(rows: list[tuple[str | None, str | None]], window: int) -> tuple[list[str | None], list[Patterns]]:
    """(ids of the items, their patterns by length); a window that an item repeats counts once."""
    items = Items(rows)
    many = np.diff(items.first)
    out = []
    for m in np.unique(np.minimum(many[many > 0], window)).tolist():
        own = np.flatnonzero(many == m if m < window else many >= m)
        count = many[own] - m + 1
        item = np.repeat(own, count)
        starts = items.first[item] + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        h, _ = window_hashes(items.hashes, np.array([0, len(items.hashes)]), m)
        order = np.lexsort((h[starts], item))
        starts, item = starts[order], item[order]
        again = (item[1:] == item[:-1]) & (h[starts[1:]] == h[starts[:-1]])
        for j in range(m):
            again &= items.hashes[starts[1:] + j] == items.hashes[starts[:-1] + j]
        out.append(Patterns(m, items, starts[np.r_[True, ~again]]))
    return items.ids, out


def _scan(column, patterns: list[Patterns]):
    """For each text: number of words, merged word spans that are hit, numbers of the items found."""
    n_words, spans, items = [], [], []
    data, offsets = text_bytes(column)
    for a, b in chunks(offsets):
        own = offsets[a : b + 1] - offsets[a]
        part = data[offsets[a] : offsets[b]]
        starts, ends, first = words(part, own, WORD_ALNUM)
        h = word_hashes(part, starts, ends)
        low = lowered(part)
        hit = np.zeros(len(h) + 1, np.int64)
        rows_found, items_found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for g in patterns:
            place, item = g.search(low, starts, ends, h, first)
            np.add.at(hit, place, 1)
            np.add.at(hit, place + g.length, -1)
            rows_found.append(np.searchsorted(first, place, "right") - 1)
            items_found.append(item)
        inside = np.zeros(len(h) + 2, bool)
        inside[1:-1] = np.cumsum(hit[:-1]) > 0
        edge = np.zeros(len(h) + 2, bool)
        edge[first + 1] = True
        up = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[1:-1]))
        down = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[2:])) + 1
        row = np.searchsorted(first, up, "right") - 1
        cut = np.searchsorted(row, np.arange(b - a + 1)).tolist()
        pairs = np.unique(np.stack([np.concatenate(rows_found), np.concatenate(items_found)]), axis=1)
        cut_items = np.searchsorted(pairs[0], np.arange(b - a + 1)).tolist()
        n_words += np.diff(first).tolist()
        for i in range(b - a):
            s = slice(cut[i], cut[i + 1])
            spans.append(np.stack([up[s] - first[i], down[s] - first[i]], axis=1).tolist() if s.stop > s.start else [])
            items.append(pairs[1, cut_items[i] : cut_items[i + 1]].tolist() if cut_items[i + 1] > cut_items[i] else [])
    return n_words, spans, items


def _merged(spans: list[list[int]]) -> list[list[int]]:
    """Spans as runs: of spans that meet or overlap one is made."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _grouped(benchmark: DataFrame, item: str, text: str, table_bytes: int):
    """The benchmark in groups whose tables have about table_bytes at most; each is fetched only when it is to be broadcast."""
    b = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{text}`").alias("words")).filter("words is not null")
    taken = F.octet_length("words") + WORD_BYTES * F.regexp_count("words", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"))
    size = b.agg(F.coalesce(F.sum(taken), F.lit(0)).alias("n")).first()["n"]
    n = int(-(-size // table_bytes)) or 1
    for k in range(n):
        yield [(r["item"], r["words"]) for r in (b if n == 1 else b.filter(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == k)).toLocalIterator()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = 20, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Adds to each document n_words, hit_spans (merged word spans inside occurrences of windows), n_hit, item_ids (found,
    sorted as strings) and contaminated (n_hit > 0 and share * n_hit >= n_words).
    """
    spark = prepared(docs.sparkSession)
    col = lambda c: F.col(f"`{c}`")
    kept = [c for c in docs.columns if c not in ("n_words", "hit_spans", "n_hit", "item_ids", "contaminated")]
    read, n_words, hit_spans, item_ids = free_names(docs, "read", "n_words", "hit_spans", "item_ids")
    out = docs.select(*[col(c) for c in kept], *([] if text in kept else [col(text).alias(read)]))
    read = text if text in kept else read
    new = [T.StructField(n, T._parse_datatype_string(t)) for n, t in ((n_words, "bigint"), (hit_spans, "array<array<bigint>>"), (item_ids, "array<string>"))]
    schema = T.StructType([*out.schema.fields, *new])

    def scan(sent):
        def run(batches):
            ids, patterns = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                n, spans, items = _scan(batch.column(read), patterns)
                names = [{ids[i] for i in x} for x in items]
                if hit_spans in batch.schema.names:  # what the groups before have found
                    spans = [_merged(x + y) if x and y else x or y for x, y in zip(batch.column(hit_spans).to_pylist(), spans, strict=True)]
                    names = [x | set(y) for x, y in zip(names, batch.column(item_ids).to_pylist(), strict=True)]
                names = [sorted(x, key=lambda i: (i is None, i)) for x in names]
                columns = [pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(names, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in schema.names[:-3]], *columns], names=schema.names)

        return run

    for rows in _grouped(benchmark, item, item_text, table_bytes):
        out = out.transform(in_batches, scan(spark.sparkContext.broadcast(patterns_of(rows, window))), schema)
    n_hit = F.aggregate(col(hit_spans), F.lit(0).cast("bigint"), lambda s, x: s + x[1] - x[0])
    return out.select(*[col(c) for c in kept], col(n_words).alias("n_words"), col(hit_spans).alias("hit_spans"), n_hit.alias("n_hit"), col(item_ids).alias("item_ids"), ((n_hit > 0) & (share * n_hit >= col(n_words))).alias("contaminated"))


def decontamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """An item without id counts in n_items and has no part in items_sha256."""
    found = decontaminate(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")
