"""Line dedup: an exact set-similarity join of lines, of which later matches are removed.

A line's set holds its distinct words (A-Z as a-z). Words are ordered by rarity, from counters over all lines.
Lines of similarity share/100 or more share one of their rarest words, so each line names these (prefix
filter) with its size, the word's place and a 128-bit signature. Lines that meet are kept apart by size
(length filter), by what can still follow the shared word (positional filter) and by the bits in which
their signatures differ; then Jaccard is verified on the whole sets. A line goes if it matches any line
that stands earlier, by doc_id and line number, whether or not that one goes too.

Lines with equal sets meet by a signature of 128 bits, so copies need no pairs: all but the first go. Of the other lines
each names its ``FEW`` earliest candidates for each word; the earliest is verified first, then the rest for
lines still undecided. Words of which a line has more candidates keep their rows, and lines without a match among the
few are compared with all of these. Verification cuts only the lines that are asked for into words.

Every line that has a word takes part; with a higher ``min_words`` lines of fewer distinct words stay. Lines so short that
only equal sets are similar need no join: the signatures find them. Null texts stay null, empty texts empty. Rows that
repeat a doc_id are handled alike; lines of equal doc_id and number are not earlier than one another.
Rows without doc_id have no place in the order: they stay whole and remove nothing. Very long lines and texts
count whole. An empty table gives an empty result. Extra columns are kept; output columns replace namesakes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arcwise.llm import packed
from arcwise.llm.blocks import U64, WORD_SPACE, bit_count, chunks, mix, text_bytes, word_hashes, words
from arcwise.llm.shared import few_files, free_names, in_batches, lookup, prepared, written

MIN_WORDS = 1
SHARE = 80
FEW = 48
_ROW = np.dtype([("token", "<u4"), ("line", "<u4"), ("doc", "<i8"), ("n", "<u2"), ("at", "<u2"), ("sum", "<u4"), ("bits", "<u8", 2)])
#: Level of a counter that has counted one line only: nothing else holds its words.
_ONCE = 2
_SAME = np.dtype([("s1", "<u8"), ("s2", "<u8"), ("doc", "<i8"), ("line", "<u4")])
#: Bytes of a text beyond which it is handled in pieces.
_LONG = 8_000_000
#: Pairs that are compared at once.
_PAIRS = 2_000_000


class Lines:
    """The lines of min_words distinct words or more in a block of texts: the sorted hashes of their words, rare ones first if there is a table.

    asked(row, number) leaves only some lines, before they are cut into words.
    """

    def __init__(self, data, offsets, min_words: int, table=None, asked=None, before: int = 0):
        feeds = np.flatnonzero(data == 10)
        at = np.union1d(offsets[:-1], feeds + 1)
        at = at[at < len(data)]
        row = np.searchsorted(offsets, at, "right") - 1
        number = np.searchsorted(feeds, at) - np.searchsorted(feeds, offsets[row]) + before
        size = np.diff(np.r_[at, len(data)])
        if asked:
            some = asked(row, number)
            if not some.all():
                data, row, number, size = data[np.repeat(some, size)], row[some], number[some], size[some]
        starts, ends, first = words(data, np.r_[0, np.cumsum(size)], WORD_SPACE)
        h = word_hashes(data, starts, ends)
        line = np.repeat(np.arange(len(size)), np.diff(first))
        key = h if table is None else packed.rarity_keys(table, h)
        shift = U64(max(len(size), 2).bit_length())
        near = (line.astype(U64) << (U64(64) - shift)) | (key >> shift)
        order = np.argsort(near)
        near, h, line = near[order], h[order], line[order]
        same = near[1:] == near[:-1]
        if (same & (h[1:] != h[:-1])).any():  # different words whose keys begin alike
            order = np.lexsort((h, key[order], line))
            h, line = h[order], line[order]
            same = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
        if same.any():
            new = np.r_[True, ~same]
            h, line = h[new], line[new]
        size = np.bincount(line, minlength=len(row))
        good = size >= min_words
        if not good.all():
            h = h[good[line]]
        self.h, self.sizes, self.row, self.number = h, size[good], row[good], number[good]
        self.starts = np.cumsum(self.sizes) - self.sizes


def _blocks(batches, min_words, table=None, asked=None):
    """(ids, lines) of blocks of texts; asked(doc, number) leaves only some lines."""

    def some(docs):
        return (lambda row, number: asked(docs[row], number)) if asked else None

    for batch in batches:
        docs = batch.column("doc").to_numpy()
        data, offsets = text_bytes(batch.column("text"))
        for a, b in chunks(offsets):
            part = data[offsets[a] : offsets[b]]
            if len(part) <= _LONG:
                yield docs[a:b], Lines(part, offsets[a : b + 1] - offsets[a], min_words, table, some(docs[a:b]))
                continue
            # A very long text: in pieces that end with a line.
            feeds, at, before = np.flatnonzero(part == 10) + 1, 0, 0
            while at < len(part):
                nth = int(np.searchsorted(feeds, at + _LONG, "right"))
                to = int(feeds[nth - 1]) if nth > before else int(feeds[nth]) if nth < len(feeds) else len(part)
                if nth == len(feeds) and len(part) - at <= _LONG:
                    to = len(part)
                yield docs[a:b], Lines(part[at:to], np.array([0, to - at]), min_words, table, some(docs[a:b]), before)
                at, before = to, int(np.searchsorted(feeds, to, "right"))


def _census(docs: DataFrame, min_words: int) -> DataFrame:
    """One pass for the counters of words (slice, task, counts) and the packed signatures of lines (bucket, block)."""
    buckets = packed.buckets_of(docs.sparkSession)
    names = ["bucket", "block", "slice", "task", "counts", "doc", "line"]
    kinds = [pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]

    def row(n, **columns):
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names=names)

    def run(batches):
        from pyspark import TaskContext

        sketch = packed.Sketch()
        for ids, x in _blocks(batches, min_words):
            if not len(x.sizes):
                continue
            sketch.add(x.h)
            m = mix(x.h + U64(0x632BE59BD9B4E019))
            out = np.empty(len(x.sizes), _SAME)
            out["s1"] = np.bitwise_xor.reduceat(m, x.starts) + x.sizes.astype(U64)
            out["s2"] = np.add.reduceat(m, x.starts)
            out["doc"], out["line"] = ids[x.row], x.number
            # Copies within a block are told at once: a line with very many of them sends one row a block.
            first, late = _first_copies(out)
            if len(late):
                yield row(len(late), doc=late["doc"], line=late["line"].astype(np.int64))
            b = packed.packed(mix(first["s1"].copy()), first, buckets)
            yield row(b.num_rows, bucket=b.column(0), block=b.column(1))
        b = sketch.batch(TaskContext.get().partitionId())
        yield row(b.num_rows, slice=b.column(0), task=b.column(1), counts=b.column(2))

    return docs.transform(in_batches, run, "bucket int, block binary, slice int, task int, counts binary, doc bigint, line bigint")


def _first_copies(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that hold a set first, rows of later copies) of signatures. Lines at the first one's place, of rows that repeat a doc_id, are neither."""
    r = r[np.lexsort((r["line"], r["doc"], r["s2"], r["s1"]))]
    same = (r["s1"][1:] == r["s1"][:-1]) & (r["s2"][1:] == r["s2"][:-1])
    lead = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(r)), 0))
    return r[np.unique(lead)], r[(r["doc"] != r["doc"][lead]) | (r["line"] != r["line"][lead])]


def _later_copies(blocks: DataFrame) -> DataFrame:
    """(doc, line) of the lines whose set an earlier line of another block has."""

    def work(r):
        _, late = _first_copies(r)
        yield pa.RecordBatch.from_arrays([pa.array(late["doc"]), pa.array(late["line"].astype(np.int64))], names=["doc", "line"])

    return packed.by_bucket(blocks, work, _SAME, "doc bigint, line bigint")


def _prefix(x: Lines, table: np.ndarray, share: int):
    """(kept, line, place): each line's rarest words that other lines may have."""
    size = x.sizes - -(-share * x.sizes // 100) + 1
    at = np.arange(len(x.h)) - np.repeat(x.starts, x.sizes)
    kept = np.flatnonzero(at < np.repeat(np.where(x.sizes * 100 // share > x.sizes, size, 0), x.sizes))
    kept = kept[packed.level_of(table, x.h[kept]) > _ONCE]
    return kept, np.searchsorted(x.starts, kept, "right") - 1, at[kept]


def _rarest(docs: DataFrame, table, min_words: int, share: int) -> DataFrame:
    """Packed rows of each line's rarest words."""
    buckets = packed.buckets_of(docs.sparkSession)

    def run(batches):
        for ids, x in _blocks(batches, min_words, table.value):
            if not len(x.sizes):
                continue
            kept, own, at = _prefix(x, table.value, share)
            one = U64(1) << (x.h & U64(63))
            half = x.h & U64(64) > 0
            bits = np.stack([np.bitwise_xor.reduceat(np.where(half == k, one, U64(0)), x.starts) for k in (False, True)], axis=1)
            sums = np.add.reduceat(x.h, x.starts)
            # Of lines with equal sets in a block the earliest stands for all.
            order = np.lexsort((x.number, ids[x.row], sums, bits[:, 0], bits[:, 1], x.sizes))
            again = np.r_[False, np.all([k[order][1:] == k[order][:-1] for k in (sums, bits[:, 0], bits[:, 1], x.sizes)], axis=0)]
            if again.any():
                lone = np.ones(len(order), bool)
                lone[order[again]] = False
                some = lone[own]
                kept, own, at = kept[some], own[some], at[some]
            h = x.h[kept]
            out = np.empty(len(own), _ROW)
            out["token"] = (h >> U64(7)).astype(np.uint32)
            out["line"], out["doc"] = x.number[own], ids[x.row][own]
            out["n"], out["at"], out["bits"] = np.minimum(x.sizes, 65535)[own], np.minimum(at, 65535), bits[own]
            out["sum"] = sums[own] >> U64(32)
            yield packed.packed(h, out, buckets)

    return docs.transform(in_batches, run, "bucket int, block binary")


def _asked(lines):
    """The lines that a broadcast Bloom filter of lines leaves, as _blocks asks for it."""
    return lambda doc, number: packed.bloom_has(lines.value, _xxhash64(_line_id(doc, number)))


_PAIR = "doc bigint, line bigint, doc_a bigint, line_a bigint, more boolean, bucket int, block binary"
_NAMES = ["doc", "line", "doc_a", "line_a", "more", "bucket", "block"]


def _candidates(rows: DataFrame, share: int, few: int | None, only=None) -> DataFrame:
    """(doc, line, doc_a, line_a, more): lines and earlier lines that the filters leave; the few earliest for each word, more: there were others.
    Of words with such lines also (bucket, block): the word's rows, from which all candidates can be told later.

    only: a broadcast Bloom filter of the lines that are asked about.
    """
    buckets = packed.buckets_of(rows.sparkSession)

    def work(r):
        # By word and size; lines of equal sets, told by 32 bits of sum besides bits, size and place, stand together.
        key = (r["token"].astype(U64) << U64(32)) | (r["n"].astype(U64) << U64(16)) | (r["sum"] & 0xFFFF).astype(U64)
        r = r[np.argsort(key)]
        if len(r):
            new = np.r_[True, np.any([x[1:] != x[:-1] for x in (r["token"], r["n"], r["sum"], r["at"], r["bits"][:, 0], r["bits"][:, 1])], axis=0)]
            many = np.diff(np.r_[np.flatnonzero(new), len(r)])
            # Of these the earliest stands for all: the others go as copies.
            twice = np.flatnonzero(np.repeat(many > 1, many))
            if len(twice):
                run = np.cumsum(new)[twice]
                twice = twice[np.lexsort((r["line"][twice], r["doc"][twice], run))]
                heads = np.r_[True, run[1:] != run[:-1]]
                keep = np.repeat(many == 1, many)
                keep[twice[heads]] = True
                r = r[keep]
        n, bits, at = r["n"].astype(np.int64), np.ascontiguousarray(r["bits"]), r["at"].astype(np.int64)
        group = np.cumsum(np.r_[True, r["token"][1:] != r["token"][:-1]])
        # Partners of row i are the rows after it, of the same word, up to the size that its own allows.
        stop = np.searchsorted((group << 20) + n, (group << 20) + n * 100 // share, "right")
        count = np.maximum(stop - np.arange(len(r)) - 1, 0)
        total = np.cumsum(count)
        i0, crowded = 0, np.zeros(len(r) + 1, bool)
        while i0 < len(r):
            i1 = max(i0 + 1, int(np.searchsorted(total, (total[i0 - 1] if i0 else 0) + _PAIRS, "right")))
            c = count[i0:i1]
            i = np.repeat(np.arange(i0, i1), c)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
            i0 = i1
            if not len(i):
                continue
            apart = bit_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
            need = -(-share * (n[i] + n[j]) // (100 + share))
            whole = (n[i] == 65535) | (n[j] == 65535)
            ok = (((n[i] + n[j] - apart) // 2 >= need) & (np.minimum(n[i] - at[i], n[j] - at[j]) >= need)) | whole
            i, j = i[ok], j[ok]
            swap = (r["doc"][i] > r["doc"][j]) | ((r["doc"][i] == r["doc"][j]) & (r["line"][i] > r["line"][j]))
            a, b = np.where(swap, j, i), np.where(swap, i, j)
            ok = (r["doc"][a] != r["doc"][b]) | (r["line"][a] != r["line"][b])
            if only:
                ok &= packed.bloom_has(only.value, _xxhash64(_line_id(r["doc"][b], r["line"][b].astype(np.int64))))
            a, b = a[ok], b[ok]
            order = np.lexsort((r["line"][a], r["doc"][a], b))
            a, b = a[order], b[order]
            new = np.r_[True, b[1:] != b[:-1]] if len(b) else np.zeros(0, bool)
            heads = np.flatnonzero(new)
            many = np.diff(np.r_[heads, len(b)])
            nth = np.arange(len(b)) - np.repeat(heads, many)
            keep = nth < (few or len(r))
            more = np.repeat(many > (few or len(r)), many)[keep]
            a, b = a[keep], b[keep]
            crowded[group[b[more]]] = True
            a, b = r[a], r[b]
            yield pa.RecordBatch.from_arrays([pa.array(b["doc"]), pa.array(b["line"].astype(np.int64)), pa.array(a["doc"]), pa.array(a["line"].astype(np.int64)), pa.array(more), pa.nulls(len(b), pa.int32()), pa.nulls(len(b), pa.binary())], names=_NAMES)
        if crowded.any():
            left = r[crowded[group]]
            b = packed.packed(mix(left["token"].astype(U64)), left, buckets)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(b.num_rows, k) for k in (*[pa.int64()] * 4, pa.bool_())], *b.columns], names=_NAMES)

    return packed.by_bucket(rows, work, _ROW, _PAIR)


def _matches(pairs: DataFrame, docs: DataFrame, min_words: int, share: int) -> DataFrame:
    """The lines (doc, line) of pairs that are similar to (doc_a, line_a)."""
    spark = pairs.sparkSession
    ends = pairs.select("doc", "line").unionByName(pairs.select(F.col("doc_a").alias("doc"), F.col("line_a").alias("line")))
    lines = spark.sparkContext.broadcast(packed.bloom(ends.select(_line_id(F.col("doc"), F.col("line")).alias("id")), "id"))

    def sets(batches):
        for doc, x in _blocks(batches, min_words, None, _asked(lines)):
            if len(x.sizes):
                flat = x.h.tobytes()
                got = [flat[8 * a : 8 * b] for a, b in zip(x.starts.tolist(), (x.starts + x.sizes).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc[x.row]), pa.array(x.number.astype(np.int64)), pa.array(got, pa.binary())], names=["doc", "line", "items"])

    own = written(few_files(docs, docs).transform(in_batches, sets, "doc bigint, line bigint, items binary"), "sets", 0)
    full = pairs.select("doc", "line", "doc_a", "line_a").join(own.withColumnRenamed("items", "x"), ["doc", "line"])
    full = full.join(own.select(F.col("doc").alias("doc_a"), F.col("line").alias("line_a"), F.col("items").alias("y")), ["doc_a", "line_a"])

    def exact(batches):
        for batch in batches:
            x, nx = _numbers(batch.column("x"))
            y, ny = _numbers(batch.column("y"))
            keep = pa.array(_common(x, nx, y, ny) * (100 + share) >= share * (nx + ny))
            yield pa.RecordBatch.from_arrays([batch.column("doc").filter(keep), batch.column("line").filter(keep)], names=["doc", "line"])

    return full.select("doc", "line", "x", "y").transform(in_batches, exact, "doc bigint, line bigint")


def _numbers(column) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers of a binary column of hashes, how many each row has)."""
    data, offsets = text_bytes(column)
    return data.view(U64), np.diff(offsets) // 8


def _common(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """How many numbers the i-th set of x and the i-th set of y have in common."""
    rows = len(nx)
    row = np.concatenate([np.repeat(np.arange(rows), nx), np.repeat(np.arange(rows), ny)])
    h = np.concatenate([x, y])
    shift = U64(max(rows, 2).bit_length())
    near = (row.astype(U64) << (U64(64) - shift)) | (h >> shift)
    order = np.argsort(near)
    near, h, row = near[order], h[order], row[order]
    same = near[1:] == near[:-1]
    if (same & (h[1:] != h[:-1])).any():  # different hashes that begin alike
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        same = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    return np.bincount(row[1:][same], minlength=rows)


def _line_id(doc, line):
    """One number for a line; others may share it."""
    return doc % 1_000_000_007 * 1_000_003 + line


def _xxhash64(x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of longs, seed 42."""
    p1, p2, p3, p4, p5 = (U64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, k: (v << U64(k)) | (v >> U64(64 - k))
    h = np.full(len(x), 42 + 8, U64) + p5
    h ^= turn(x.view(U64) * p2, 31) * p1
    h = turn(h, 27) * p1 + p4
    h ^= h >> U64(33)
    h *= p2
    h ^= h >> U64(29)
    h *= p3
    return (h ^ (h >> U64(32))).view(np.int64)


def repeated_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, share: int = SHARE) -> DataFrame:
    """(doc, line) of all lines that match an earlier one, each once; lines are numbered from 0."""
    spark = prepared(docs.sparkSession)
    source = docs.select(F.col(f"`{doc}`").cast("bigint").alias("doc"), F.col(f"`{text}`").alias("text")).filter("doc is not null and text is not null")
    tasks = few_files(source, source).rdd.getNumPartitions()
    census = written(_census(few_files(source, source), min_words), "census", 0)
    table = spark.sparkContext.broadcast(packed.levels(census.filter("slice is not null").select("slice", "task", "counts"), tasks))
    gone = _later_copies(census.filter("bucket is not null").select("bucket", "block")).unionByName(census.filter("line is not null").select("doc", "line"))
    gone = written(gone.distinct(), "copies")
    candidates = written(_candidates(_rarest(source, table, min_words, share), share, FEW), "candidates", 0)
    pair = ["doc", "line", "doc_a", "line_a"]
    found = candidates.filter("bucket is null").join(gone, ["doc", "line"], "left_anti").groupBy(*pair).agg(F.max("more").alias("more"))
    found = written(found, "pairs")

    first = found.groupBy("doc", "line").agg(F.min(F.struct("doc_a", "line_a")).alias("a")).select("doc", "line", "a.*")
    near = written(_matches(first, source, min_words, share).distinct(), "matches")
    left = found.join(near, ["doc", "line"], "left_anti")
    rest = left.select(*pair)
    open_ = written(left.filter("more").select("doc", "line").distinct(), "open")
    if not open_.isEmpty():
        asked = spark.sparkContext.broadcast(packed.bloom(open_.select(_line_id(F.col("doc"), F.col("line")).alias("id")), "id"))
        every = _candidates(candidates.filter("bucket is not null").select("bucket", "block"), share, None, asked).filter("bucket is null")
        rest = rest.unionByName(every.select(*pair).join(open_, ["doc", "line"], "left_semi")).distinct()
    rest = written(rest.join(first, pair, "left_anti"), "rest")
    if not rest.isEmpty():
        near = written(near.unionByName(_matches(rest, source, min_words, share).distinct()), "matches")
    return gone.unionByName(near)


def drop_repeated_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, share: int = SHARE) -> DataFrame:
    """docs with the repeated lines cut out of the text, and n_lines and n_removed."""
    key, bits, lines = free_names(docs, "doc", "bits", "lines")
    gone = repeated_lines(docs, doc, text, min_words, share).groupBy(F.col("doc").alias(key)).agg(F.array_sort(F.collect_set("line")).alias("at"))
    # A byte for each line up to the last repeated one: a line is looked up at once, however many there are.
    upto = F.arrays_zip(F.col("at").alias("at"), F.concat(F.array(F.lit(-1).cast("bigint")), F.slice("at", 1, F.size("at") - 1)).alias("before"))
    marks = F.transform(upto, lambda x: F.concat(F.repeat(F.lit("0"), (x["at"] - x["before"] - 1).cast("int")), F.lit("1")))
    gone = lookup(gone.select(key, F.array_join(marks, "").cast("binary").alias(bits)), F.octet_length(bits) + 40)
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    col = lambda c: F.col(f"`{c}`")
    rows = docs.select(*[col(c) for c in kept], F.split(col(text), "\n", -1).alias(lines)).join(gone, col(doc) == col(key), "left")
    left = F.filter(lines, lambda x, i: F.substring(col(bits), i + 1, F.lit(1)) != F.lit("1").cast("binary"))
    repeated = col(bits).isNotNull() & col(text).isNotNull()
    n = F.coalesce(F.size(lines), F.lit(0))
    removed = F.when(repeated, n - F.size(left)).otherwise(0)
    cut = F.when(repeated, F.array_join(left, "\n")).otherwise(col(text))
    out = rows.select(*[cut.alias(c) if c == text else col(c) for c in kept], F.when(col(text).isNull(), 0).otherwise(n).cast("bigint").alias("n_lines"), removed.cast("bigint").alias("n_removed"))
    return few_files(out, docs)


def line_digest(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    out = drop_repeated_lines(docs.select("doc_id", "text"), min_words=min_words)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
