"""Vectorised work on Arrow string columns: whole batches of text as one byte array.

A batch of texts is a flat ``uint8`` array with offsets, so tokenising and hashing are numpy
passes over bytes and never loops over characters. Batches are cut to a few MB of text
(one longer text stays whole), which bounds the memory of a Python worker.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once.
CHUNK_BYTES = 1_000_000

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

#: Byte classes. WORD_SPACE: words are runs of other bytes. WORD_ALNUM: words are runs of digits, letters and bytes from 0x80.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD_SPACE = np.ones(256, dtype=bool)
WORD_SPACE[[0x20, *range(0x09, 0x0E)]] = False
WORD_ALNUM = np.zeros(256, dtype=bool)
WORD_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)]] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges (a, b) of rows with at most ``limit`` bytes each, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, for at least n places."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1024)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=U64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer (splitmix64 finaliser) of a uint64 array, in place on a copy."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of (symbol + 1) * base**place over places i..j-1, modulo 2**64."""
    up, _ = powers(len(symbols))
    out = np.zeros(len(symbols) + 1, U64)
    x = symbols.astype(U64)
    x += U64(1)
    x *= up[: len(symbols)]
    np.cumsum(x, dtype=U64, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end), independent of where they stand."""
    _, down = powers(len(sums))
    x = (sums[ends] - sums[starts]) * down[starts]
    x += (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)
    return mix(x)


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of the words, none over a row's end; first[i]: index of row i's first word, with a last entry."""
    n = len(data)
    inside = kind[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_LANES = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Up to so many bytes a word is hashed in lanes of eight; longer ones by BLAKE2.
_LANE_BYTES = 64
_TURN, _SPREAD = U64(29), U64(0xD6E8FEB86659FD93)


def lanes(data: np.ndarray) -> np.ndarray:
    """At each place, the number of which the eight bytes from there on are the digits; zeros stand behind the end."""
    held = np.zeros(len(data) + 8, np.uint8)
    held[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", held.data, strides=(1,))


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes, A-Z as a-z."""
    return data | ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, A-Z as a-z.

    Words of up to eight bytes of UTF-8 all have hashes of their own. Longer ones are mixed lane after lane, so that no
    sum of places cancels out; those of more than _LANE_BYTES bytes have eight bytes of BLAKE2.
    """
    low = lowered(data)
    at = lanes(low)
    size = ends - starts
    h = at[starts]
    h &= _LANES[np.minimum(size, 8)]
    # 0xFF never stands in UTF-8: eight bytes are told apart from fewer and their number.
    h ^= np.where(size < 8, size.astype(U64) << U64(56), U64(0xFFFFFFFFFFFFFFFF))
    h = mix(h)
    long = np.flatnonzero(size > 8)
    if not len(long):
        return h
    huge = long[size[long] > _LANE_BYTES]
    long = long[size[long] <= _LANE_BYTES]
    start, left, x = starts[long], size[long], h[long]
    x += left.astype(U64) * _SPREAD
    while len(long):
        start = start + 8
        left = left - 8
        x = mix(((x << _TURN) | (x >> U64(35))) ^ (at[start] & _LANES[np.minimum(left, 8)]))
        more = left > 8
        if not more.all():
            h[long[~more]] = x[~more]
            long, start, left, x = long[more], start[more], left[more], x[more]
    for i in huge:
        h[i] = int.from_bytes(hashlib.blake2b(low[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def same_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether the words of one lower-cased text equal those of another, byte by byte."""
    size = ends - starts
    same = size == other_ends - other_starts
    x, y, at = lanes(data), lanes(other), 0
    open_ = np.flatnonzero(same)
    while len(open_) and at < _LANE_BYTES:
        mask = _LANES[np.minimum(size[open_] - at, 8)]
        equal = (x[starts[open_] + at] & mask) == (y[other_starts[open_] + at] & mask)
        same[open_[~equal]] = False
        at += 8
        open_ = open_[equal & (size[open_] > at)]
    for i in open_:
        same[i] = data[starts[i] + at : ends[i]].tobytes() == other[other_starts[i] + at : other_ends[i]].tobytes()
    return same


def _chained(size: int, word) -> np.ndarray:
    """Hashes of ``size`` words in order; word(j): the hashes of the j-th ones."""
    x = word(0) + U64(size * 0x9E3779B97F4A7C15 % (1 << 64))
    for j in range(1, size):
        x = (((x << _TURN) | (x >> U64(35))) ^ word(j)) * _SPREAD
    return mix(x)


def window_hashes(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first): of each run of ``size`` words within a row; a row of fewer words, but not none, has its whole sequence as one."""
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=at[1:])
    rows = np.repeat(np.arange(len(n)), count)
    starts = first[rows] + np.arange(at[-1]) - at[rows]
    out = np.empty(at[-1], U64)
    whole = n[rows] >= size
    if whole.any():
        runs = len(hashes) - size + 1
        out[whole] = _chained(size, lambda j: hashes[j : j + runs])[starts[whole]]
    for m in range(1, size):
        own = np.flatnonzero((n == m))
        if len(own):
            out[at[own]] = _chained(m, lambda j: hashes[first[own] + j])  # noqa: B023
    return out, at


def bit_count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)
