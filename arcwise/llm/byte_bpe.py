"""Byte-level BPE encoding and decoding with the ``tokenizers`` library over Arrow batches.

A rank file (lines of base64 token and rank) becomes a ``tokenizers`` model: bytes are mapped to
printable characters, and each token's merge is the pair that lower ranks leave of it. Texts are split by the
pattern and each distinct piece is encoded once in a task, which keeps the ids and offsets of KEPT_BYTES of pieces at
most. Offsets are given in characters of the input text: tokens that share a character's bytes each have that character.
Decoding maps ids back to bytes by the same table, so characters whose bytes lie in several tokens come out whole.

Null text is empty: no ids. Empty text: no ids. Very long texts are encoded whole. Repeated rows
are encoded each on its own. An empty table gives an empty result. Other columns are kept as they
are; the output columns replace columns of the same name.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from itertools import chain
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from arcwise.llm.blocks import chunks, text_bytes
from arcwise.llm.shared import in_batches, prepared

_loaded: dict[str, "ByteBpe"] = {}
#: Bytes of memory of the pieces whose ids a task keeps, and what a piece takes besides its text, ids and offsets.
KEPT_BYTES, _PIECE_BYTES = 64_000_000, 230
#: Pieces that are encoded in one call.
_AT_ONCE = 5_000


def byte_chars() -> list[str]:
    """The character for each byte: printable Latin-1 stays, the rest follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    keep = set(plain)
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


def merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that merges of lower rank leave of a token; None if they leave more."""
    parts = [token[i : i + 1] for i in range(len(token))]
    own = ranks[token]
    while len(parts) > 2:
        best = min(((ranks.get(a + b, own), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(own, 0))
        if best[0] >= own:
            return None
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


class ByteBpe:
    """A rank file's tokenizer."""

    def __init__(self, content: bytes, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in content.splitlines() if x.strip())}
        chars = byte_chars()
        shown = {token: "".join(chars[b] for b in token) for token in ranks}
        merges = [p for t in sorted(ranks, key=ranks.get) if len(t) > 1 and (p := merge_of(t, ranks))]
        model = models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=[(shown[a], shown[b]) for a, b in merges])
        chars_only = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.model, self.pieces = Tokenizer(model), Tokenizer(model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), chars_only])
        self.pieces.pre_tokenizer = chars_only
        self.split, self.found = regex.compile(pattern).findall, regex.compile(pattern).finditer
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        back = {c: b for b, c in enumerate(chars)}
        for text, i in self.model.get_vocab().items():
            self.bytes_of[i] = bytes(back[c] for c in text)
        self.sizes = np.array([len(x) for x in self.bytes_of], np.int64)

    def encode_with_offsets(self, texts: list[str]) -> list[tuple[list[int], list[tuple[int, int]]]]:
        return [(x.ids, x.offsets) for x in self.model.encode_batch(texts, add_special_tokens=False)]

    def decode(self, ids) -> bytes:
        """Bytes of the ids; ids that the vocabulary lacks raise IndexError."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Pieces:
    """Ids of texts, by their pieces; those seen in this task are kept up to KEPT_BYTES."""

    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe
        self.clear()

    def clear(self):
        self.ids: dict[str, bytes] = {}
        self.held = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        split = [self.bpe.split(t) for t in texts]
        every = {p for pieces in split for p in pieces}
        if self.held > KEPT_BYTES:
            self.clear()
        new = list(every - self.ids.keys())
        for i in range(0, len(new), _AT_ONCE):
            part = new[i : i + _AT_ONCE]
            ids = np.array(self.bpe.pieces.encode_batch_fast([part], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
            # Tokens tile their piece, so lengths in bytes tell where it ends.
            ends = np.cumsum([len(p.encode()) for p in part])
            cut = 4 * (np.searchsorted(np.cumsum(self.bpe.sizes[ids]), ends) + 1)
            said = ids.tobytes()
            self.ids.update(zip(part, [said[a:b] for a, b in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True)], strict=True))
        self.held += len(new) * _PIECE_BYTES + 2 * sum(map(len, new))
        return [b"".join(map(self.ids.__getitem__, pieces)) for pieces in split]


def located(bpe: ByteBpe, texts: list[str], ids: list[np.ndarray]) -> list[np.ndarray]:
    """(start, end) in characters of each token of each text: the characters that its first and last byte belong to."""
    data, at = text_bytes(pa.array(texts, pa.large_string()))
    size = bpe.sizes[np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int64)]
    first = np.r_[0, np.cumsum([len(x) for x in ids])]
    ends = np.cumsum(size)
    begins = ends - size
    said = np.r_[0, ends][first]
    for i in np.flatnonzero(np.diff(said) != np.diff(at)):  # a pattern that leaves out some of the text: by its pieces
        spans = [(len(texts[i][: m.start()].encode()), len(m[0].encode())) for m in bpe.found(texts[i])]
        begun, long = np.array(spans, np.int64).reshape(-1, 2).T
        left = np.repeat(begun - np.cumsum(long) + long, long)
        own = slice(first[i], first[i + 1])
        begins[own] += left[begins[own] - said[i]]
        ends[own] = begins[own] + size[own]
    shift = np.repeat(at[:-1] - said[:-1], np.diff(first))
    begins, ends = begins + shift, ends + shift
    chars = np.cumsum((data & 0xC0) != 0x80)
    before = np.repeat(np.r_[0, chars][at[:-1]], np.diff(first))
    out = np.stack([chars[begins] - 1 - before, chars[ends - 1] - before], axis=1).astype("<u4") if len(size) else np.zeros((0, 2), "<u4")
    return [out[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def rank_file(path: str) -> tuple[bytes, str]:
    """Content of a rank file, read on the driver, and its digest."""
    with open(path, "rb") as f:
        content = f.read()
    return content, hashlib.sha256(content).hexdigest()


def _shipped(df: DataFrame, path: str, pattern: str):
    """Broadcasts the rank file (below 1 MB; its size doesn't depend on the data); returns what loads it once in a worker."""
    content, name = rank_file(path)
    sent = df.sparkSession.sparkContext.broadcast(content)
    return lambda: loaded(name, sent.value, pattern)


def loaded(name: str, content: bytes, pattern: str) -> ByteBpe:
    """A rank file's tokenizer, made once in a worker."""
    if (key := name + pattern) not in _loaded:
        _loaded[key] = ByteBpe(content, pattern)
    return _loaded[key]


def _text_lists(column) -> Iterator[list[str]]:
    _, offsets = text_bytes(column)
    for a, b in chunks(offsets):
        yield [x or "" for x in column.slice(a, b - a).to_pylist()]


def _mapped(df: DataFrame, inputs: list[str], outputs: list[tuple[str, str]], begin) -> DataFrame:
    """df with the columns that begin()'s result gives for each Arrow batch of a task."""
    kept = [c for c in df.columns if c not in {n for n, _ in outputs}]
    source = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, *inputs])])
    fields = [source.schema[c] for c in kept]
    schema = T.StructType([*fields, *[T.StructField(n, T._parse_datatype_string(t)) for n, t in outputs]])

    def run(batches):
        work = None
        for batch in batches:
            if batch.num_rows:
                work = work or begin()
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *work(batch)], names=[*kept, *[n for n, _ in outputs]])

    return source.transform(in_batches, run, schema)


def bpe_encode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds ``ids`` array<int> and ``offsets`` array<array<int>> (start and end of each token in characters) of every text."""
    prepared(df.sparkSession)
    load = _shipped(df, path, pattern)

    def begin():
        bpe = load()

        def work(batch):
            ids, at = [], []
            for texts in _text_lists(batch.column(text)):
                for i, o in bpe.encode_with_offsets(texts):
                    ids.append(i)
                    at.append([list(x) for x in o])
            return [pa.array(ids, pa.list_(pa.int32())), pa.array(at, pa.list_(pa.list_(pa.int32())))]

        return work

    return _mapped(df, [text], [("ids", "array<int>"), ("offsets", "array<array<int>>")], begin)


def bpe_decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` binary: the bytes of the ids; null ids are empty."""
    prepared(df.sparkSession)
    load = _shipped(df, path, pattern)

    def begin():
        bpe = load()
        return lambda batch: [pa.array([bpe.decode(x or ()) for x in batch.column(ids).to_pylist()], pa.binary())]

    return _mapped(df, [ids], [("decoded", "binary")], begin)


def bpe_round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", keep_ids: bool = False, offsets: bool = False) -> DataFrame:
    """Encodes and decodes in one pass; adds n_tokens, ids_sha256 (ids as little-endian uint32) and decoded_sha256, ids if they are
    to be kept, and with ``offsets`` offsets_sha256 (start and end of each token in characters, likewise).
    """
    prepared(df.sparkSession)
    load = _shipped(df, path, pattern)

    def begin():
        bpe = load()
        known = Pieces(bpe)

        def work(batch):
            n, i_sha, d_sha, o_sha, kept = [], [], [], [], []
            for texts in _text_lists(batch.column(text)):
                said = known.encode(texts)
                ids = [np.frombuffer(x, "<u4") for x in said]
                n += map(len, ids)
                i_sha += [hashlib.sha256(x).hexdigest() for x in said]
                d_sha += [hashlib.sha256(bpe.decode(x.tolist())).hexdigest() for x in ids]
                if keep_ids:
                    kept += ids
                if offsets:
                    o_sha += [hashlib.sha256(x.tobytes()).hexdigest() for x in located(bpe, texts, ids)]
            flat = np.concatenate([*kept, np.zeros(0, "<u4")]).astype(np.int32)
            ids = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(flat))] if keep_ids else []
            return [pa.array(n, pa.int64()), pa.array(i_sha, pa.string()), pa.array(d_sha, pa.string()), *[pa.array(o_sha, pa.string())] * offsets, *ids]

        return work

    outputs = [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string"), *[("offsets_sha256", "string")] * offsets, *[("ids", "array<int>")] * keep_ids]
    return _mapped(df, [text], outputs, begin)
