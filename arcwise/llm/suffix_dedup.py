"""Suffix-array dedup: removes bytes inside strings of ``length`` bytes that also start in a document with a smaller id.

Every string of ``length`` bytes belongs to the least hash of its runs of ``GRAM`` bytes, so equal strings meet under the
same hash wherever they stand; neighbouring strings under one hash make a fragment. Texts are dealt out in an order that
doesn't change, and cut to parts. In a first pass the hashes of fragments meet, and each part gets back two bits for each of its fragments:
whether its hash occurs again, and whether with several kinds of fragments. In the second pass fragments that are alone stay, those of
one kind go by place, and those of several with their bytes. Under each hash the strings of its distinct fragments that may
have an equal one (by a hash, which never misses one) are joined to one text, whose suffixes are sorted by Lyndon-prefix groups
(suffix_groups); suffixes that share their first ``length`` bytes stand together, and the least id among their fragments decides for all
of them. Where a hash has one distinct fragment, its order is that fragment's. Removed strings are merged to runs by part.

Nothing is broadcast, and what travels follows from the fragments' own company, however large the table is: no hash shares a table's slot
with others. Texts travel three times, to be cut and to meet their bits and their runs, each time after what the pass before left is gone.

Null and empty texts have no bytes. Texts under ``length`` bytes lose nothing. Very long texts count whole, in pieces.
Rows that repeat a doc_id don't come before one another. Rows without doc_id keep all bytes and take none from others. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arcwise.llm import packed
from arcwise.llm.blocks import U64, mix, powers, prefix_sums, span_hashes, text_bytes
from arcwise.llm.shared import discarded, exchanges_gone, few_files, in_batches, prepared, written
from arcwise.llm.suffix_groups import sort_many, sort_one

LENGTH = 50
GRAM = 20
#: Strings of one fragment at most.
_MOST = 64
#: Bytes of text that a pass looks at together, bytes of joined fragments sorted together, and from where on one hash's are sorted alone.
_PIECE, _TOGETHER, _ALONE = 500_000, 600_000, 6_000
#: Bytes of a part (one longer text is a part of its own), and buckets for each shuffle partition.
_PART, _BUCKETS = 4_000_000, 2
#: Bits of a part's number within its partition.
_PART_BITS = 24
#: Groups that are sorted together at least.
_ROWS = 64

_SEEN = np.dtype([("h", "<u4"), ("h2", "u1"), ("f", "<u8")])
_PLACE = np.dtype([("h", "<u4"), ("h2", "u1"), ("doc", "<i8"), ("at", "<u4"), ("n", "u1")])
_RUN = np.dtype([("part", "<i8"), ("at", "<u4"), ("n", "u1")])


def fragments(data: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, gram: int):
    """(hash, start, n, fragment's hash) of the fragments: runs of n strings of ``length`` bytes with one least hash.

    Strings start in [first, last) of the texts, of which last is exclusive.
    """
    width = length - gram + 1
    sums = prefix_sums(data)
    _, down = powers(len(data) + 1)
    low = sums[gram:] - sums[:-gram]
    low *= down[: len(low)]
    low = mix(low)
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    edge = np.zeros(len(low) + 1, np.int8)
    np.add.at(edge, first, 1)
    np.add.at(edge, last, -1)
    sel = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    if not len(sel):
        return np.zeros(0, U64), sel, sel, np.zeros(0, U64)
    new = np.zeros(len(low), bool)
    new[first] = True
    h = low[sel]
    cut = np.flatnonzero(new[sel] | np.r_[True, h[1:] != h[:-1]])
    n = np.diff(np.r_[cut, len(sel)])
    if n.max() > _MOST:  # the same hash again and again: cut by count
        parts = -(-n // _MOST)
        at = np.repeat(cut, parts) + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * _MOST
        n = np.minimum(np.repeat(cut + n, parts) - at, _MOST)
        cut = at
    start = sel[cut]
    # Least hashes are small numbers; mixed again they spread over buckets and slots.
    return mix(h[cut]), start, n, span_hashes(sums, start, start + n + length - 1)


def _pieces(batches, length: int, gram: int):
    """(bytes, doc, text's hash, place in its text, fragments) of blocks of texts; a long text comes in pieces that overlap."""
    for batch in batches:
        ids, kinds = batch.column("doc").to_numpy(), batch.column("kind").to_numpy()
        data, offsets = text_bytes(batch.column("text"))
        size = np.diff(offsets)
        own = np.flatnonzero(size >= length)
        spans = [(i, a, min(a + _PIECE, int(size[i]) - length + 1)) for i in own for a in range(0, int(size[i]) - length + 1, _PIECE)]
        at = 0
        while at < len(spans):
            to, total = at, 0
            while to < len(spans) and (to == at or total + spans[to][2] - spans[to][1] + length <= _PIECE):
                total += spans[to][2] - spans[to][1] + length
                to += 1
            rows, begins, ends = np.array(spans[at:to]).T
            at = to
            lengths = ends - begins + length - 1
            base = np.r_[0, np.cumsum(lengths)]
            part = np.concatenate([data[offsets[i] + a : offsets[i] + a + k] for i, a, k in zip(rows, begins, lengths, strict=True)])
            h, start, n, f = fragments(part, base[:-1], base[1:] - length + 1, length, gram)
            which = np.searchsorted(base, start, "right") - 1
            yield part, ids[rows[which]], kinds[rows[which]], begins[which] + start - base[which], h, start, n, f


def _dealt(rows: DataFrame, n: int, more: DataFrame | None = None) -> DataFrame:
    """(deal, doc, text, part, bucket, more): texts dealt out to n partitions in an order of their own, behind the rows (part, bucket, more) of their partition."""
    none = lambda kind: F.lit(None).cast(kind)
    out = rows.select(F.pmod(F.xxhash64("doc", "text"), F.lit(n)).cast("int").alias("deal"), "doc", "text", none("bigint").alias("part"), none("int").alias("bucket"), none("binary").alias("more"))
    if more is not None:
        out = out.union(more.select(F.shiftright("part", _PART_BITS).cast("int"), none("bigint"), none("string"), "part", "bucket", "more"))
    return out.repartitionById(n, F.col("deal")).sortWithinPartitions("deal", "doc", "text")


def _parts(batches):
    """(part, ids, offsets, bytes, its (bucket, more) rows) of parts of the dealt texts; where they are cut doesn't depend on the batches."""
    deal, number, said, held, total = None, 0, {}, [], 0

    def part():
        docs, sizes, texts = (np.concatenate(x) for x in zip(*held, strict=True))
        at = int(deal) << _PART_BITS | number
        return at, docs, np.r_[0, np.cumsum(sizes)], texts, said.get(at, ())

    for batch in batches:
        deals, texts = batch.column("deal").to_numpy(), batch.column("doc").is_valid().to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.r_[True, (deals[1:] != deals[:-1]) | (texts[1:] != texts[:-1])])
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(deals)], strict=True):
            if deals[a] != deal:
                if held:
                    yield part()
                deal, number, said, held, total = deals[a], 0, {}, [], 0
            own = batch.slice(a, b - a)
            if not texts[a]:
                for at, bucket, more in zip(own.column("part").to_pylist(), own.column("bucket").to_pylist(), own.column("more"), strict=True):
                    said.setdefault(at, []).append((bucket, more.as_py()))
                continue
            data, offsets = text_bytes(own.column("text"))
            docs = own.column("doc").to_numpy()
            weight = np.r_[0, np.cumsum(np.diff(offsets) + 16)]
            x = 0
            while x < b - a:
                y = int(np.searchsorted(weight, weight[x] + _PART - total, "right")) - 1
                if y <= x and held:
                    yield part()
                    number, held, total = number + 1, [], 0
                    continue
                y = max(y, x + 1)
                held.append((docs[x:y], np.diff(offsets[x : y + 1]), data[offsets[x] : offsets[y]].copy()))
                total += int(weight[y] - weight[x])
                x = y
    if held:
        yield part()


def _fragments(batches, length: int, gram: int):
    """(part, bytes, its rows, doc, byte, place, fragments) of parts that have any. A place is one more than the byte for each text before: no two texts touch."""
    for part, docs, offsets, data, said in _parts(batches):
        texts = pa.Array.from_buffers(pa.large_binary(), len(docs), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        block = pa.RecordBatch.from_arrays([pa.array(docs), texts, pa.array(np.arange(len(docs), dtype=np.int32))], names=["doc", "text", "kind"])
        held = []
        for _, doc, text, at, h, _, n, f in _pieces([block], length, gram):
            byte = offsets[text] + at
            held.append((doc, byte, byte + text, h, n, f))
        if held:
            yield part, data, said, *(np.concatenate(x) for x in zip(*held, strict=True))


def _where(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int32)


def company(key: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each fragment, whether its key occurs again, and whether with several kinds."""
    order = np.lexsort((kind, key))
    key, kind = key[order], kind[order]
    new = np.r_[True, key[1:] != key[:-1]]
    group = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    other = np.r_[False, kind[1:] != kind[:-1]] & ~new
    out = np.empty((2, len(key)), bool)
    out[0, order] = (np.diff(np.r_[heads, len(key)]) > 1)[group]
    out[1, order] = np.logical_or.reduceat(other, heads)[group]
    return out[0], out[1]


def _met(dealt: DataFrame, n: int, length: int, gram: int) -> DataFrame:
    """(part, bucket, more): ``company`` of a part's fragments in a bucket as bits, in their order; rows without any are left out."""
    names = ["part", "bucket", "more"]

    def seen(batches):
        for part, _, _, _, _, _, h, _, f in _fragments(batches, length, gram):
            out = np.empty(len(h), _SEEN)
            out["h"], out["h2"], out["f"] = h >> U64(32), (h >> U64(24)) & U64(255), f
            b = packed.packed(h, out, n * _BUCKETS)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, part)), *b.columns], names=names)

    def answers(bucket, parts, blocks):
        sizes = [len(b) // _SEEN.itemsize for b in blocks]
        r = np.frombuffer(b"".join(blocks), _SEEN)
        twice, several = company((r["h"].astype(np.int64) << 8) | r["h2"], r["f"])
        out, a = [], 0
        for part, m in zip(parts, sizes, strict=True):
            if twice[a : a + m].any():
                out.append((part, np.packbits(np.r_[twice[a : a + m], several[a : a + m]]).tobytes()))
            a += m
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([bucket] * len(out), pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=names)

    return _by_bucket(dealt.transform(in_batches, seen, "part bigint, bucket int, more binary"), n, answers, "part bigint, bucket int, more binary")


def _by_bucket(rows: DataFrame, n: int, work, schema: str) -> DataFrame:
    """work(bucket, columns) for each bucket's rows: values of the other columns, those of binary ones as buffers."""

    def run(batches):
        now, held = None, []
        for batch in batches:
            others = [x for x, name in zip(batch.columns, batch.schema.names, strict=True) if name != "bucket"]
            columns = [(v.as_buffer() for v in x) if pa.types.is_binary(x.type) else x.to_pylist() for x in others]
            for bucket, *row in zip(batch.column("bucket").to_pylist(), *columns, strict=True):
                if bucket != now and held:
                    yield from work(now, *zip(*held, strict=True))
                    held = []
                now = bucket
                held.append(row)
        if held:
            yield from work(now, *zip(*held, strict=True))

    return rows.repartition(n, "bucket").sortWithinPartitions("bucket").transform(in_batches, run, schema)


def _travelling(dealt: DataFrame, n: int, length: int, gram: int) -> DataFrame:
    """(bucket, part, places, known, bytes): fragments that have company; the last ``known`` bytes belong to those with several kinds, which come last."""

    def run(batches):
        for part, data, said, doc, byte, place, h, many, _ in _fragments(batches, length, gram):
            bits, own = dict(said), _where(h, n * _BUCKETS)
            order = np.argsort(own, kind="stable")
            own = own[order]
            cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            where, blocks, texts, known = [], [], [], []
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(own)], strict=True):
                if (got := bits.get(int(own[a]))) is None:
                    continue
                twice, several = np.unpackbits(np.frombuffer(got, np.uint8), count=2 * (b - a)).view(bool).reshape(2, -1)
                wide = order[a:b][several]
                sel = np.r_[order[a:b][twice & ~several], wide]
                rows = np.empty(len(sel), _PLACE)
                rows["h"], rows["h2"] = h[sel] >> U64(32), (h[sel] >> U64(24)) & U64(255)
                rows["doc"], rows["at"], rows["n"] = doc[sel], place[sel], many[sel]
                where.append(int(own[a]))
                blocks.append(rows.tobytes())
                texts.append(data[_places(byte[wide], many[wide] + length - 1)].tobytes())
                known.append(len(wide))
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array([part] * len(where), pa.int64()), pa.array(blocks, pa.binary()), pa.array(known, pa.int32()), pa.array(texts, pa.binary())], names=["bucket", "part", "places", "known", "bytes"])

    return dealt.transform(in_batches, run, "bucket int, part bigint, places binary, known int, bytes binary")


def _places(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... (many[i] of them), one after the other."""
    ends = np.cumsum(many)
    return np.repeat(begin - ends + many, many) + np.arange(ends[-1] if len(ends) else 0)


class _Joined:
    """The texts of some groups, one after the other: a group's fragments are joined, a 0 behind each; symbols are byte values plus one."""

    def __init__(self, groups, data: np.ndarray, length: int):
        self.length = length
        starts, self.n, self.low = (np.concatenate([g[i] for g in groups]) for i in range(3))
        self.n = self.n.astype(np.int64)
        size = self.n + length
        self.at = np.cumsum(size) - size
        self.x = np.zeros(int(size.sum()), np.int16)
        self.x[_places(self.at, size - 1)] = data[_places(starts, size - 1)].astype(np.int16) + 1
        self.many = np.array([len(g[0]) for g in groups])  # fragments of each group
        self.first = np.r_[0, np.cumsum(self.many)]
        self.edge = np.r_[self.at, len(self.x)][self.first]  # where each group begins

    def text(self, k: int) -> np.ndarray:
        return self.x[self.edge[k] : self.edge[k + 1]]

    def decided(self, orders: list[np.ndarray]) -> list[np.ndarray]:
        """For each group, the least id of each string of each fragment, given its suffixes in order."""
        order = np.concatenate([o + e for o, e in zip(orders, self.edge, strict=False)])
        owner = np.searchsorted(self.at, order, "right") - 1
        own = order - self.at[owner] < self.n[owner]
        order, owner = order[own], owner[own]
        group = np.repeat(np.arange(len(self.many)), self.many)[owner]
        views = np.lib.stride_tricks.sliding_window_view(self.x, self.length)
        same = np.zeros(len(order), bool)
        for i in range(0, len(order) - 1, 20_000):
            j = min(i + 20_000, len(order) - 1)
            same[i + 1 : j + 1] = (views[order[i + 1 : j + 1]] == views[order[i:j]]).all(axis=1)
        same[1:] &= group[1:] == group[:-1]
        head = np.flatnonzero(~same)
        nth = np.cumsum(self.n) - self.n
        place = np.empty(len(order), np.int64)
        place[nth[owner] + order - self.at[owner]] = np.repeat(np.minimum.reduceat(self.low[owner], head), np.diff(np.r_[head, len(order)]))
        return np.split(place, np.r_[nth, len(order)][self.first[1:-1]])


def least_ids(groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]], data: np.ndarray, length: int) -> list[np.ndarray]:
    """For each group (starts, string counts, least ids of its distinct fragments): the least id of each string of each fragment, in order.

    Suffixes that share their first ``length`` symbols stand together in a group's order. Symbol 256 becomes the free value 255 where
    the group allows it.
    """
    out: list = [None] * len(groups)
    sizes = np.array([int(np.sum(n.astype(np.int64) + length)) for _, n, _ in groups])
    ranked = np.argsort(sizes, kind="stable")
    i = 0
    while i < len(ranked):
        low = sizes[ranked[i]]
        j = i + 1
        while j < len(ranked) and sizes[ranked[j]] <= _ALONE and sizes[ranked[j]] * (j - i + 1) <= _TOGETHER and sizes[ranked[j]] <= max(1.3 * low, low + 40):
            j += 1
        t = _Joined([groups[k] for k in ranked[i:j]], data, length)
        orders: list = [None] * (j - i)
        if j - i >= _ROWS:
            table = np.zeros((j - i, int(sizes[ranked[j - 1]])), np.uint8)
            for row in range(j - i):
                x = t.text(row)
                if x.max() < 256:  # byte 255 never stands in UTF-8; other bytes may be anything
                    table[row, : len(x)] = x
            for row, order in enumerate(sort_many(table)):
                # Behind a row's text come zeros; their suffixes are no strings.
                orders[row] = order[order < len(t.text(row))] if table[row].any() else None
        # Too few for a step in all rows at once to pay, or with a symbol that no row can hold: one by one.
        t_orders = [np.array(sort_one(t.text(row).tolist())) if o is None else o for row, o in enumerate(orders)]
        for k, least in zip(ranked[i:j], t.decided(t_orders), strict=True):
            out[k] = least
        i = j
    return out


def _bounds(hit: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the runs of places that are hit and have one owner."""
    inner = own[1:] == own[:-1]
    return np.flatnonzero(hit & np.r_[True, ~(hit[:-1] & inner)]), np.flatnonzero(hit & np.r_[~(hit[1:] & inner), True]) + 1


def _may_equal(hashes: np.ndarray, group: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Whether a string may equal one of its group that has another least id: whether its hash does. Equal strings have equal hashes."""
    key = hashes + mix(group.astype(U64))
    order = np.argsort(key, kind="stable")
    key, low = key[order], low[order]
    new = np.r_[True, key[1:] != key[:-1]]
    heads = np.flatnonzero(new)
    out = np.empty(len(key), bool)
    out[order] = (np.minimum.reduceat(low, heads) < np.maximum.reduceat(low, heads))[np.cumsum(new) - 1]
    return out


def _removed(rows: np.ndarray, part: np.ndarray, known: np.ndarray, data: np.ndarray, length: int) -> np.ndarray:
    """Runs of removed strings among a bucket's fragments; known: start of each fragment's bytes in data, or -1."""
    key = (rows["h"].astype(np.int64) << 8) | rows["h2"]
    n = rows["n"].astype(np.int64)
    has = known >= 0
    kind = np.zeros(len(rows), U64)
    if has.any():
        sums = prefix_sums(data)
        kind[has] = span_hashes(sums, known[has], known[has] + n[has] + length - 1)
    order = np.lexsort((rows["at"], part, rows["doc"], kind, key))
    rows, key, kind, known, n, part = rows[order], key[order], kind[order], known[order], n[order], part[order]
    doc = rows["doc"]
    new_key = np.r_[True, key[1:] != key[:-1]]
    new_kind = new_key | np.r_[True, kind[1:] != kind[:-1]]
    heads = np.flatnonzero(new_kind)  # the least id's fragment of each kind
    ends = np.r_[heads[1:], len(rows)]
    kinds = np.cumsum(new_kind) - 1
    low = doc[heads]
    gone = np.flatnonzero(doc > low[kinds])
    runs = [np.stack([gone, np.zeros(len(gone), np.int64), n[gone]])]
    starts = np.flatnonzero(new_key[heads])
    many = np.diff(np.r_[starts, len(heads)])
    # Nothing goes among the kinds of one document.
    mixed = (many > 1) & (np.minimum.reduceat(low, starts) != np.maximum.reduceat(doc[ends - 1], starts))
    if mixed.any():
        some = _places(starts[mixed], many[mixed])  # the kinds of these groups
        group = np.repeat(np.arange(np.count_nonzero(mixed)), many[mixed])
        size = n[heads[some]]
        own = np.repeat(np.arange(len(some)), size)
        string = _places(known[heads[some]], size)
        may = _may_equal(span_hashes(sums, string, string + length), group[own], low[some][own])
        begin, end = _bounds(may, own)
        cuts = np.flatnonzero(np.r_[True, np.diff(group[own[begin]]) > 0, True]) if len(begin) else begin
        left = [(string[begin[x:y]], end[x:y] - begin[x:y], low[some[own[begin[x:y]]]]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        if left:
            # The order of their suffixes tells which strings are equal.
            hit = np.zeros(len(own), bool)
            hit[may] = np.concatenate(least_ids(left, data, length)) < low[some][own][may]
            begin, end = _bounds(hit, own)
            at = begin - (np.cumsum(size) - size)[own[begin]]
            # Each fragment of the kind's least document loses them; those of later ones are gone whole.
            copies = np.add.reduceat((doc == low[kinds]).astype(np.int64), heads)[some[own[begin]]]
            runs.append(np.stack([_places(heads[some[own[begin]]], copies), np.repeat(at, copies), np.repeat(end - begin, copies)]))
    place, shift, size = np.concatenate(runs, axis=1)
    out = np.empty(len(place), _RUN)
    out["part"], out["at"], out["n"] = part[place], rows["at"][place] + shift, size
    return out


def _runs(travelling: DataFrame, n: int, length: int) -> DataFrame:
    """(bucket, block) of removed runs, by part."""

    def work(_, parts, places, known, texts):
        rows, starts, base = [], [], 0
        for p, k, t in zip(places, known, texts, strict=True):
            r = np.frombuffer(p, _PLACE)
            at = np.full(len(r), -1, np.int64)
            if k:
                sizes = r["n"][len(r) - k :].astype(np.int64) + length - 1
                at[len(r) - k :] = base + np.cumsum(sizes) - sizes
            rows.append(r)
            starts.append(at)
            base += len(t)
        part = np.repeat(np.array(parts, np.int64), [len(r) for r in rows])
        out = _removed(np.concatenate(rows), part, np.concatenate(starts), np.frombuffer(b"".join(texts), np.uint8), length)
        # Each bucket writes a block for each partition of parts.
        yield packed.packed(mix(out["part"].astype(np.int64).view(U64)), out, n)

    return _by_bucket(travelling, n, work, "bucket int, block binary")


def _spans(runs: DataFrame, length: int) -> DataFrame:
    """(part, more): each part's removed places as merged (start, end) pairs of int64."""

    def work(r):
        r = r[np.lexsort((r["at"], r["part"]))]
        start, end = r["at"].astype(np.int64), r["at"].astype(np.int64) + r["n"] + length - 1
        new = np.r_[True, r["part"][1:] != r["part"][:-1]]
        # Ends so far within a part: parts are set apart by more than any place.
        apart = np.cumsum(new).astype(np.int64) << 33
        reach = np.maximum.accumulate(end + apart)
        fresh = new | np.r_[True, (start + apart)[1:] > reach[:-1]]
        at = np.flatnonzero(fresh)
        a, b = start[at], (reach - apart)[np.r_[at[1:] - 1, len(r) - 1]]
        part = r["part"][at]
        heads = np.flatnonzero(new[at])
        spans = np.stack([a, b], axis=1).astype("<i8")
        blocks = [spans[x:y].tobytes() for x, y in zip(heads, np.r_[heads[1:], len(at)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(part[heads]), pa.array(blocks, pa.binary())], names=["part", "more"])

    return packed.by_bucket(runs, work, _RUN, "part bigint, more binary")


def _apart(batches):
    """(doc, text, spans) of dealt texts behind their parts' spans."""
    for _, docs, offsets, data, said in _parts(batches):
        spans = np.frombuffer(b"".join(x for _, x in said), "<i8").reshape(-1, 2)
        begins = offsets[:-1] + np.arange(len(docs))
        first = np.searchsorted(spans[:, 0], np.r_[begins, 1 << 62])
        blocks = [(spans[a:b] - begin).tobytes() if b > a else None for a, b, begin in zip(first[:-1], first[1:], begins, strict=True)]
        texts = pa.Array.from_buffers(pa.large_string(), len(docs), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(docs), texts, pa.array(blocks, pa.binary())], names=["doc", "text", "spans"])


def repeated_strings(docs: DataFrame, doc: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, text, spans) for every row: spans is null or the removed bytes' (start, end) pairs as little-endian int64."""
    spark = prepared(docs.sparkSession)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc).cast("bigint").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    some = rows.filter("doc is not null")
    with exchanges_gone(spark):
        met = written(_met(_dealt(some, n), n, length, gram), "met", 0)
        runs = written(_runs(_travelling(_dealt(some, n, met), n, length, gram), n, length), "runs", 0)
    discarded(met)
    spans = _spans(runs, length).select("part", F.lit(None).cast("int").alias("bucket"), "more")
    out = _dealt(some, n, spans).transform(in_batches, _apart, "doc bigint, text string, spans binary")
    return few_files(out.union(rows.filter("doc is null").withColumn("spans", F.lit(None).cast("binary"))), docs)


def suffix_dedup(docs: DataFrame, doc: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, kept, removed) for every row: the remaining bytes, and the merged removed (start, end) pairs."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            kept, removed = [], []
            for a, b, s in zip(offsets[:-1], offsets[1:], batch.column("spans").to_pylist(), strict=True):
                spans = np.frombuffer(s or b"", "<i8").reshape(-1, 2)
                removed.append(spans.tolist())
                cuts = np.r_[0, spans.ravel(), b - a] + a
                kept.append(b"".join(data[x:y].tobytes() for x, y in zip(cuts[::2], cuts[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(kept, pa.binary()), pa.array(removed, pa.list_(pa.list_(pa.int64())))], names=["doc", "kept", "removed"])

    return repeated_strings(docs, doc, text, length, gram).transform(in_batches, run, "doc bigint, kept binary, removed array<array<bigint>>")


def suffix_digest(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            n, removed, spans, sha = [], [], [], []
            for kept, gone in zip(batch.column("kept").to_pylist(), batch.column("removed").to_pylist(), strict=True):
                cut = sum(b - a for a, b in gone)
                n.append(len(kept) + cut)
                removed.append(cut)
                spans.append(len(gone))
                sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return suffix_dedup(docs.select("doc_id", "text")).transform(in_batches, run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
