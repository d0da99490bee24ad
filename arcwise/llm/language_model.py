"""LM scoring: a causal self-attention model on subword ids, and the unigram baseline over words.

Words (A-Z as a-z) are cut into subword ids by a public rank file; a text's sequence is the ids of its words and an end id.
The probability of an id is that of its class given what stands before it, times its share of the class given the class of
the id before it. Classes are predicted by one layer of causal self-attention with positions, trained in numpy with Adam.
Without normalisation before the attention, queries, keys and values are sums of a row for the id and one for the
place, so scoring looks them up.

All training texts are learned from, in two passes. In the first each task counts words and ids, sums what stands around each id,
and writes the ids of its texts; from these sums over all training texts come the classes. In the second, over the ids, each task counts ids
by the class before them and trains the model on every window of its texts (one in ``EVERY``, which is 1); the tasks' parameters are
averaged by their windows. The parameters that all tasks begin with come from ``STEPS`` steps on the driver on ``SAMPLE`` training texts
of least id hash, of up to ``SAMPLE_BYTES`` bytes each; nothing else is taken from these.

Texts are scored in windows of ``WINDOW`` inputs that overlap by ``WINDOW - STRIDE``: each window scores its last
``STRIDE`` ids, so each id is scored once, with at least ``WINDOW - STRIDE`` inputs before it; windows are scored in batches.

The baseline needs each word's count over all training texts. Counts are summed in buckets of an exchange. The ``TOP`` most
frequent words (6 MB) are broadcast; other words meet their counts in their buckets and the sums go back to the texts.

Null and empty texts have the end only. Very long texts are scored whole. Rows that repeat a doc_id each count, are learned
from and are scored on their own; rows without doc_id are held out. Without training texts shares are even. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import copy
import itertools
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from arcwise.llm import packed
from arcwise.llm.blocks import LOWER, U64, WORD_SPACE, chunks, mix, text_bytes, word_hashes, words
from arcwise.llm.shared import few_files, in_batches, least_hashed, prepared, written

SAMPLE, SAMPLE_BYTES = 800, 100_000
TOP = 1 << 19
WINDOW, STRIDE = 32, 24
DIM = 24
CLASSES = 128
#: Classes of ids that occur in alike surroundings.
GROUPS = 72
#: Ids with a row of their own; others share their class's row.
OWN = 4_000
STEPS = 2_000
#: Of the windows of training texts, one in so many is trained on: all; windows of a step; step size, and the steps after which it falls.
EVERY, BATCH, RATE, EVEN = 1, 512, 0.006, 100
#: Windows of a step, or of texts that are scored, that are handled together.
BLOCK = 64
#: Windows of which products are taken at once: larger matrices are packed first, which takes longer than the product.
TOGETHER = 4
#: Random dimensions of what stands around ids, and how many ids stand together.
AROUND, BESIDE = 24, 24
#: Counts by which shares given the class before lean on the shares in all places.
PRIOR = 20
_END_WORD = U64(0x0E5D)
_COUNT = np.dtype([("h", "<u8"), ("uid", "<i8"), ("n", "<i8")])
_SUM = np.dtype([("uid", "<i8"), ("base", "<f8"), ("known", "<i8")])


class Subwords:
    """Subword ids of words, kept for the words seen last."""

    def __init__(self, content: bytes, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in content.splitlines() if x.strip())}
        self.end = max(ranks.values()) + 1
        self.encoding = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.feed = self.encoding.encode_ordinary("\n")
        self.clear()

    def clear(self):
        self.known, self.place = np.zeros(0, U64), np.zeros(0, np.int64)
        self.late, self.late_place = np.zeros(0, U64), np.zeros(0, np.int64)  # words since known was sorted last
        self.starts, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def encode(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has); a space stands before each word."""
        ids = np.array(self.encoding.encode_ordinary("".join(f"\n {s}" for s in strings)), np.int32)
        feeds = np.flatnonzero(ids == self.feed[0])
        if len(self.feed) == 1 and len(feeds) == len(strings) and (not len(ids) or ids[0] == self.feed[0]):
            return np.delete(ids, feeds), np.diff(np.r_[feeds, len(ids)]) - 1
        # A word holds a line feed's like: one by one.
        own = [self.encoding.encode_ordinary(f" {s}") for s in strings]
        return np.array([i for x in own for i in x], np.int32), np.array([len(x) for x in own], np.int64)

    def of(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For words of distinct, sorted hashes: their numbers in starts/ids."""
        out = np.full(len(hashes), -1, np.int64)
        for known, place in ((self.known, self.place), (self.late, self.late_place)):
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                out = np.where(known[at] == hashes, place[at], out)
        new = np.flatnonzero(out < 0)
        if not len(new):
            return out
        if len(self.starts) > 400_000:
            self.clear()
            return self.of(hashes, data, starts, ends)
        low = LOWER[data].tobytes()
        ids, many = self.encode([low[a:b].decode("utf-8", "replace") for a, b in zip(starts[new], ends[new], strict=True)])
        out[new] = len(self.starts) - 1 + np.arange(len(new))
        self.ids = np.concatenate([self.ids, ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(many)])
        late, place = np.concatenate([self.late, hashes[new]]), np.concatenate([self.late_place, out[new]])
        if len(late) > 60_000:
            late, place = np.concatenate([self.known, late]), np.concatenate([self.place, place])
        order = np.argsort(late, kind="stable")
        if len(late) > 60_000:
            self.known, self.place = late[order], place[order]
            self.late, self.late_place = late[:0], place[:0]
        else:
            self.late, self.late_place = late[order], place[order]
        return out


def gathered(starts: np.ndarray, values: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values of the lists named by which, one after the other, how many each has)."""
    many = starts[which + 1] - starts[which]
    ends = np.cumsum(many)
    return values[np.repeat(starts[which] - ends + many, many) + np.arange(ends[-1] if len(ends) else 0)], many


def directions(n: int, seed: int = 5) -> np.ndarray:
    """A random vector for each of n ids."""
    return np.random.default_rng(seed).normal(size=(n, AROUND)).astype(np.float32)


def row_sums(values: np.ndarray, which: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows of values that each stretch of ``which``, from one start to the next, names; none is empty. Eight rows of all stretches at a time, as reduceat takes each number by itself."""
    many = np.diff(np.r_[starts, len(which)])
    parts = -(-many // 8)
    ends = np.cumsum(parts)
    nth = np.arange(parts.sum()) - np.repeat(ends - parts, parts)
    begin = np.repeat(starts, parts) + nth * 8
    long = np.minimum(np.repeat(many, parts) - nth * 8, 8)
    total = np.take(values, which[begin], axis=0)
    for k in range(1, 8):
        more = np.flatnonzero(long > k)
        if 2 * len(more) > len(long):
            got = np.take(values, which[np.minimum(begin + k, len(which) - 1)], axis=0)
            got[long <= k] = 0
            total += got
        else:
            total[more] += np.take(values, which[begin[more] + k], axis=0)
    again = np.flatnonzero(parts > 1)
    if not len(again):
        return total
    out = total[ends - parts]
    out[again] = row_sums(total, np.flatnonzero(np.repeat(parts > 1, parts)), np.cumsum(parts[again]) - parts[again])
    return out


def sums_by_row(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows, the sum of the values dealt to it."""
    row = row.astype(np.int16 if n < 1 << 15 else np.int64)  # few numbers are sorted by their digits
    order = np.argsort(row, kind="stable")
    row = row[order]
    at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])[: len(row)]
    many = np.diff(np.r_[at, len(row)])
    out = np.zeros((n, values.shape[1]), values.dtype)
    # Most rows come a few times; of the others two columns are added as one complex number, which halves the calls.
    few = many <= 4
    begin, long = at[few], many[few]
    total = np.take(values, order[begin], axis=0)
    for k in (1, 2, 3):
        more = np.flatnonzero(long > k)
        total[more] += np.take(values, order[begin[more] + k], axis=0)
    out[row[begin]] = total
    if len(total) < len(at):
        long = many[~few]
        pairs = np.take(values, order[np.repeat(~few, many)], axis=0).view(np.result_type(values, np.complex64))
        out[row[at[~few]]] = np.add.reduceat(pairs, np.cumsum(long) - long, axis=0).view(values.dtype)
    return out


def contexts(ids: np.ndarray, first: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """(dimension, id): for each id, the sum over its occurrences of the mean vector of the other ids in its piece of BESIDE ids of a text."""
    size = np.diff(first)
    many = -(-size // BESIDE)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    begin = np.repeat(first[:-1], many) + nth * BESIDE
    long = np.diff(np.r_[begin, len(ids)])
    out = np.zeros((len(vectors), AROUND))
    if not len(ids):
        return out.T
    part, others = np.repeat(np.arange(len(begin)), long), 1 / np.maximum(long - 1, 1)
    pieces = np.empty((len(begin), AROUND))
    for a in range(0, len(begin), 1 << 11):  # here and below so few at a time that they stay in cache
        some = slice(a, a + (1 << 11))
        at = begin[some]
        pieces[some] = row_sums(vectors, ids[at[0] : at[-1] + long[some][-1]], at - at[0])
    pieces /= np.maximum(long - 1, 1)[:, None]
    # The pieces' sums go to their ids, each id's one after the other; then what the ids themselves brought goes.
    order = np.argsort(ids.astype(np.uint16) if len(vectors) <= 1 << 16 else ids, kind="stable")
    for a in range(0, len(order), 1 << 14):
        some = order[a : a + (1 << 14)]
        row = ids[some]
        at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[at]] += row_sums(pieces, part[some], at)
    out -= vectors * np.bincount(ids, weights=others[part], minlength=len(vectors))[:, None]
    return out.T


def clusters(points: np.ndarray, mass: np.ndarray, flags: np.ndarray, seed: int) -> np.ndarray:
    """GROUPS clusters of ids by context, apart for ids that begin a word."""
    r = np.random.default_rng(seed)
    x = points - np.average(points, axis=0, weights=mass)
    x = np.hstack([x / max(x.std(), 1e-9), 4.0 * flags[:, None]])
    middle = x[r.choice(len(x), GROUPS, replace=False, p=mass / mass.sum())]
    for _ in range(15):
        near = (np.sum(middle * middle, axis=1) - 2 * x @ middle.T).argmin(axis=1)
        total = np.bincount(near, weights=mass, minlength=GROUPS)
        sums = np.stack([np.bincount(near, weights=mass * x[:, d], minlength=GROUPS) for d in range(x.shape[1])], axis=1)
        middle[total > 0] = sums[total > 0] / total[total > 0, None]
    return near


def together(t: np.ndarray) -> np.ndarray:
    """The rows of each TOGETHER windows as one matrix; of each window, where these don't divide."""
    n = 1 if len(t) % TOGETHER else TOGETHER
    return t.reshape(len(t) // n, n * t.shape[1], t.shape[2])


@dataclass
class AttentionModel:
    """Parameters and tables. own: for each id, its row of the embedding."""

    end: int
    classes: np.ndarray
    own: np.ndarray
    share: np.ndarray  # log of each id's share of its class
    given: np.ndarray | None = None  # the same by the class of the id before
    weights: dict = field(default_factory=dict)

    @classmethod
    def begin(cls, counts: np.ndarray, starts_word: np.ndarray, around: np.ndarray | None = None, seed: int = 5) -> AttentionModel:
        """Classes: the most frequent ids alone; ids that occur three times by what stands around them (sums of ``contexts``); the rest in bands of frequency."""
        n = len(counts)
        order = np.argsort(-counts, kind="stable")
        classes = np.zeros(n, np.int64)
        single = CLASSES - GROUPS - 12
        classes[order[:single]] = np.arange(single)
        rest = order[single:]
        for flag in (0, 1):
            own = rest[starts_word[rest] == flag]
            mass = np.cumsum(counts[own] + 0.01)
            if len(own):
                classes[own] = CLASSES - 12 + flag * 6 + np.minimum((6 * mass / mass[-1]).astype(np.int64), 5)
        if around is not None:
            own = rest[counts[rest] >= 3]
            if len(own) > GROUPS:
                classes[own] = single + clusters(around.T[own] / counts[own, None], counts[own], starts_word[own], seed)
        rows = np.full(n, -1, np.int64)
        rows[order[:OWN]] = np.arange(min(OWN, n))
        own = np.where(rows >= 0, rows, min(OWN, n) + classes)
        smooth = counts + 0.5
        total = np.bincount(classes, weights=smooth, minlength=CLASSES)
        r = np.random.default_rng(seed)
        size = {"E": (min(OWN, n) + CLASSES, DIM), "P": (WINDOW, DIM), "Q": (DIM, DIM), "K": (DIM, DIM), "V": (DIM, DIM), "W": (DIM, CLASSES)}
        weights = {k: r.normal(size=s) * (0.3 if k in "EP" else DIM**-0.5) for k, s in size.items()}
        weights["b"] = np.log(np.maximum(total, 1e-9) / total.sum())
        weights = {k: x.astype(np.float32) for k, x in weights.items()}
        return cls(n - 1, classes, own, np.log(smooth / total[classes]), None, weights)

    def learn_shares(self, counts: np.ndarray, pairs: np.ndarray) -> None:
        """Shares from all counts of ids, and of ids (columns) by the class before them (rows)."""
        smooth = counts + 0.5
        self.share = np.log(smooth / np.bincount(self.classes, weights=smooth, minlength=CLASSES)[self.classes])
        prior = PRIOR * np.exp(self.share)
        self.given = np.empty((CLASSES, len(counts)), np.float32)
        for row, seen in zip(self.given, pairs, strict=True):
            row[:] = np.log((seen + prior) / (np.bincount(self.classes, weights=seen, minlength=CLASSES) + PRIOR)[self.classes])

    def before(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The class of the id before each; the end stands before a text."""
        out = np.empty(len(ids), np.int64)
        out[1:] = self.classes[ids[:-1]]
        out[first[:-1][np.diff(first) > 0]] = self.classes[self.end]
        return out

    def shares(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log of each id's share of its class."""
        return self.share[ids] if self.given is None else self.given[self.before(ids, first), ids]

    def windows(self, ids: np.ndarray, first: np.ndarray, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(inputs, scored): of texts ids[first[i]:first[i + 1]], windows of input ids, and the places in ids that each window scores, -1 beyond the text; all windows, or those at ``which``."""
        size = np.diff(first)
        many = -(-size // STRIDE)
        row = np.repeat(np.arange(len(size)), many)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        if which is not None:
            row, nth = row[which], nth[which]
        # All inputs are laid out once, each text's behind ends and before ends up to a whole window; windows are slices of that.
        lead = WINDOW - STRIDE
        room = many * STRIDE + lead
        begin = np.cumsum(room) - room
        laid = np.full(int(room.sum()) + WINDOW, self.end, np.int32)
        laid[np.arange(first[0], first[-1]) + np.repeat(begin + lead + 1 - first[:-1], size)] = ids[first[0] : first[-1]]
        laid[(begin + lead + size)[size > 0]] = self.end  # a text's last id is no input
        inputs = np.lib.stride_tricks.sliding_window_view(laid, WINDOW)[begin[row] + nth * STRIDE]
        at = first[row] + nth * STRIDE
        scored = at[:, None] + np.arange(STRIDE)
        last = np.flatnonzero(at + STRIDE > first[row + 1])
        scored[last] = np.where(scored[last] < first[row[last] + 1][:, None], scored[last], -1)
        return inputs, scored

    def forward(self, inputs: np.ndarray):
        w = self.weights
        e = self.own[inputs]
        x = w["E"][e] + w["P"]
        top = x[:, WINDOW - STRIDE :]
        q, k, v = top @ w["Q"], x @ w["K"], x @ w["V"]
        s = q @ k.transpose(0, 2, 1) * q.dtype.type(DIM**-0.5)
        s = np.where(_MASK, s, s.dtype.type(-1e9))
        a = np.exp(s - s.max(axis=2, keepdims=True))
        a /= a.sum(axis=2, keepdims=True)
        h = top + a @ v
        z = h @ w["W"] + w["b"]
        z -= z.max(axis=2, keepdims=True)
        logp = z - np.log(np.exp(z).sum(axis=2, keepdims=True))
        return e, x, q, k, v, a, h, logp

    def gradients(self, inputs: np.ndarray, want: np.ndarray, ok: np.ndarray) -> tuple[float, dict]:
        """(mean loss of the classes ``want`` where ok, its gradient by parameter): sums over blocks of windows that stay in the processor's cache."""
        w = self.weights
        kind = w["E"].dtype.type
        joined = np.hstack([w["K"], w["V"], w["Q"] * kind(DIM**-0.5)])
        sums = {"P": np.zeros_like(w["P"]), "KVQ": np.zeros_like(joined), "W": np.zeros_like(w["W"]), "b": np.zeros_like(w["b"])}
        e, dx = self.own[inputs], np.empty((*inputs.shape, DIM), kind)
        one, loss = kind(1 / max(np.count_nonzero(ok), 1)), 0.0
        for i in range(0, len(inputs), BLOCK):
            block = slice(i, i + BLOCK)
            loss += self._add_gradients(e[block], want[block], ok[block], one, dx[block], sums, joined)
        k, v, q = np.split(sums["KVQ"], 3, axis=1)
        g = {"E": sums_by_row(e.ravel(), dx.reshape(-1, DIM), len(w["E"])), "P": sums["P"], "Q": q * kind(DIM**-0.5), "K": k, "V": v, "W": sums["W"], "b": sums["b"]}
        return float(loss * one), g

    def _add_gradients(self, e: np.ndarray, want: np.ndarray, ok: np.ndarray, one, dx: np.ndarray, sums: dict, joined: np.ndarray) -> float:
        """Adds a block's gradients to sums (of keys, values and queries together, as they stand in ``joined``) and sets those of its inputs' rows; each scored place counts ``one``. Returns the sum of losses."""
        w, kind, lead = self.weights, dx.dtype, WINDOW - STRIDE
        x = np.take(w["E"], e, axis=0)
        x += w["P"]
        kvq = (together(x) @ joined).reshape(*e.shape, 3 * DIM)
        k, v, q = kvq[:, :, :DIM], kvq[:, :, DIM : 2 * DIM], kvq[:, lead:, 2 * DIM :]
        turned = np.ascontiguousarray(kvq[:, :, : 2 * DIM].transpose(0, 2, 1))  # small products of turned matrices take longer than turning them
        ones = np.ones(max(WINDOW, CLASSES), kind)
        # Without the largest number taken off first; the sums tell whether that was needed.
        with np.errstate(over="ignore"):
            a = q @ turned[:, :DIM]
            a += _HIDDEN.astype(kind)
            np.exp(a, out=a)
            weight = a @ ones[:WINDOW]
        if not (weight.min() > 1e-10 and weight.max() < 1e10):
            a = q @ turned[:, :DIM]
            a += _HIDDEN.astype(kind)
            a -= a.max(axis=2, keepdims=True)
            np.exp(a, out=a)
            weight = a @ ones[:WINDOW]
        a /= weight[:, :, None]
        seen = a @ v
        h = seen + x[:, lead:]
        near = together(h)
        # exp(z + b) is exp(z) * exp(b), so b goes into the sums over classes and the weights behind them; places that aren't scored get the factor 0.
        b = w["b"] - w["b"].max()
        grown = np.exp(b)
        with np.errstate(over="ignore"):
            products = near @ w["W"]
            p = products.reshape(-1, CLASSES)
            at = np.arange(0, p.size, CLASSES) + want.ravel()
            chosen = p.take(at) + b[want.ravel()]
            np.exp(p, out=p)
            total = p @ grown
        if not (b.min() > -60 and total.min() > 1e-10 and total.max() < 1e10):
            np.matmul(near, w["W"], out=products)
            p += b
            p -= p.max(axis=1, keepdims=True)
            chosen = p.take(at)
            np.exp(p, out=p)
            grown = ones[:CLASSES]
            total = p @ grown
        scored = ok.ravel()
        loss = float((np.log(total) - chosen)[scored].sum(dtype=np.float64))
        factor = np.where(scored, one / total, kind.type(0))
        p.ravel()[at] -= total / grown[want.ravel()]
        sums["W"] += ((near * factor.reshape(*near.shape[:2], 1)).transpose(0, 2, 1) @ products).sum(axis=0) * grown
        sums["b"] += (factor @ p) * grown
        dh = (products @ np.ascontiguousarray((w["W"] * grown).T)).reshape(h.shape)
        dh *= factor.reshape(*h.shape[:2], 1)
        d = np.empty_like(kvq)
        d[:, :lead, 2 * DIM :] = 0
        np.matmul(a.transpose(0, 2, 1), dh, out=d[:, :, DIM : 2 * DIM])
        da = dh @ turned[:, DIM:]
        seen *= dh
        da -= (seen @ ones[:DIM])[:, :, None]
        da *= a
        np.matmul(da.transpose(0, 2, 1), q, out=d[:, :, :DIM])
        np.matmul(da, k, out=d[:, lead:, 2 * DIM :])
        sums["KVQ"] += (together(x).transpose(0, 2, 1) @ together(d)).sum(axis=0)
        np.matmul(together(d), joined.T, out=together(dx))
        dx[:, lead:] += dh
        sums["P"] += dx.sum(axis=0)
        return loss

    def steps(self, batches, rates, gain: float = 0.99):
        """Adam over (inputs, classes, scored or not), one after the other; yields the losses."""
        w = self.weights
        m, u = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
        for step, ((inputs, want, ok), rate) in enumerate(zip(batches, rates, strict=False), 1):
            loss, g = self.gradients(inputs, want, ok)
            for name, grad in g.items():
                m[name] += 0.1 * (grad - m[name])
                u[name] += (1 - gain) * (grad * grad - u[name])
                w[name] -= (rate / (1 - 0.9**step)) * m[name] / (np.sqrt(u[name] * (1 / (1 - gain**step))) + 1e-8)
            yield loss

    def wanted(self, ids: np.ndarray, scored: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class at each scored place, whether it is one)."""
        return self.classes[ids].astype(np.int16)[scored], scored >= 0

    def train(self, ids: np.ndarray, first: np.ndarray, steps: int = STEPS, batch: int = 48, rate: float = 0.015, seed: int = 3) -> float:
        """Random batches of windows of texts at hand; returns the mean loss of the last fifty steps."""
        inputs, scored = self.windows(ids, first)
        r = np.random.default_rng(seed)
        picks = (r.integers(0, len(inputs), batch) for _ in range(steps))
        rates = [rate * min(1.0, 2 * (1 - step / (steps + 1))) for step in range(1, steps + 1)]
        return float(np.mean(list(self.steps(((inputs[p], *self.wanted(ids, scored[p])) for p in picks), rates))[-50:]))

    def tables(self) -> tuple:
        """What scoring looks up: inputs' rows of queries, keys, values and residuals, in single precision."""
        w = self.weights
        parts = [(w["E"], w["P"])] + [(w["E"] @ w[k], w["P"] @ w[k]) for k in "QKV"]
        (x, px), (q, pq), (k, pk), (v, pv) = parts
        f = lambda t: np.ascontiguousarray(t, np.float32)
        late = slice(WINDOW - STRIDE, WINDOW)
        return f(np.hstack([x, q * DIM**-0.5])), f(np.hstack([px, pq * DIM**-0.5])[late]), f(np.hstack([k, v])), f(np.hstack([pk, pv])), f(w["W"]), f(w["b"]), f(np.where(_MASK, 0, -1e4))

    def score(self, ids: np.ndarray, first: np.ndarray, batch: int = BLOCK) -> np.ndarray:
        """Natural log probability of each text."""
        xq, pxq, kv, pkv, out, bias, mask = self.tables()
        inputs, scored = self.windows(ids, first)
        total = np.zeros(len(ids), np.float64)
        reach, high, ones = np.sqrt((out * out).sum(axis=0).max()), np.abs(bias).max(), np.ones(len(bias), np.float32)
        few, grown = np.ones(WINDOW, np.float32), np.exp(bias) if high < 80 else None
        named, done, whole = self.classes[ids], 0, np.arange(batch * STRIDE) * CLASSES
        for a in range(0, len(inputs), batch):
            e = self.own[inputs[a : a + batch]]
            late = np.take(xq, e[:, WINDOW - STRIDE :], axis=0)
            late += pxq
            both = np.take(kv, e, axis=0)
            both += pkv
            s = late[:, :, DIM:] @ np.ascontiguousarray(both[:, :, :DIM].transpose(0, 2, 1))
            s += mask
            if s.max() > 60:
                s -= s.max(axis=2, keepdims=True)
            np.exp(s, out=s)
            weight = s @ few
            h = s @ both[:, :, DIM:]
            h /= weight[:, :, None]
            h += late[:, :, :DIM]
            # Windows follow their texts, so the places they score follow one another.
            ok = scored[a : a + batch] >= 0
            n = np.count_nonzero(ok)
            if n == h.size // DIM and len(h) % TOGETHER == 0:
                near = h.reshape(-1, DIM)
            else:
                near = np.zeros((-(-n // (TOGETHER * STRIDE)) * TOGETHER * STRIDE, DIM), np.float32)
                near[:n] = h[ok]
            place = slice(done, done := done + n)
            # No number is larger than the lengths allow; only if that isn't enough are the numbers themselves looked at.
            small = n and np.sqrt(np.einsum("ij,ij->i", near, near).max()) * reach + high < 80
            z = (near.reshape(-1, TOGETHER * STRIDE, DIM) @ out).reshape(-1, CLASSES)[:n]
            own = named[place]
            if small:
                # exp(z + bias) is exp(z) * exp(bias).
                want = z.take(whole[:n] + own).astype(np.float64) + bias[own]
                np.exp(z, out=z)
                total[place] = want - np.log(z @ grown)
                continue
            z += bias
            if len(z) and (z.max() > 80 or z.min() < -80):
                z -= z.max(axis=1, keepdims=True)
            want = z.take(whole[:n] + own).astype(np.float64)
            np.exp(z, out=z)
            total[place] = want - np.log(z @ ones)
        total += self.shares(ids, first)
        sums = np.r_[0, np.cumsum(total)]
        return sums[first[1:]] - sums[first[:-1]]


#: Query i of a window, at place WINDOW - STRIDE + i, sees the keys up to its own.
_MASK = np.arange(WINDOW)[None, :] <= (WINDOW - STRIDE + np.arange(STRIDE))[:, None]
_HIDDEN = np.where(_MASK, 0.0, -1e9)
_loaded: dict[bytes, Subwords] = {}


def _subwords(content: bytes, pattern: str) -> Subwords:
    key = content[:64] + content[-64:] + pattern.encode()
    if key not in _loaded:
        _loaded[key] = Subwords(content, pattern)
    return _loaded[key]


class _Texts:
    """Words of a block of texts: the distinct ones, and which word stands where."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, self.first = words(data, offsets, WORD_SPACE)
        h = word_hashes(data, starts, ends)
        self.hashes, where, self.which = np.unique(h, return_index=True, return_inverse=True)
        self.data, self.starts, self.ends = data, starts[where], ends[where]

    def sequences(self, sub: Subwords) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): each text's ids and the end id."""
        number = sub.of(self.hashes, self.data, self.starts, self.ends)[self.which]
        ids, many = gathered(sub.starts, sub.ids, number)
        upto = np.r_[0, np.cumsum(many)][self.first]
        out = np.full(len(ids) + len(self.first) - 1, sub.end, np.int32)
        text = np.repeat(np.arange(len(upto) - 1), np.diff(upto))
        out[np.arange(len(ids)) + text] = ids
        return out, upto + np.arange(len(upto))


def _texts(batches):
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for a, b in chunks(offsets):
            yield batch.slice(a, b - a), _Texts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _merged(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    return h[at], np.add.reduceat(n, at) if len(at) else n


def add_counts(totals: np.ndarray, which: np.ndarray) -> None:
    """Adds to each total how often it is named. Sorted first, so that the totals are gone through in order and each once."""
    which = np.sort(which.astype(np.int32) if len(totals) < 1 << 31 else which)
    at = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])[: len(which)]
    totals[which[at]] += np.diff(np.r_[at, len(which)]).astype(totals.dtype)


class Learner:
    """Trains a copy of a model on one window in EVERY of the texts that come by."""

    def __init__(self, model: AttentionModel):
        self.model = copy.deepcopy(model)
        self.passed = self.trained = 0
        self.held: list = []
        self.rest = self.model.steps(self.batches(), (RATE * min(1.0, (EVEN / step) ** 0.5) for step in itertools.count(1)))

    def see(self, ids: np.ndarray, first: np.ndarray) -> None:
        size = np.diff(first)
        many = int(np.sum(-(-size // STRIDE)))
        inputs, scored = self.model.windows(ids, first, np.arange(-self.passed % EVERY, many, EVERY))
        self.passed += many
        if len(inputs):
            self.held.append((inputs, *self.model.wanted(ids, scored)))
        if sum(len(x[0]) for x in self.held) >= BATCH:
            self.train()

    def train(self, least: int = BATCH) -> None:
        if self.held:
            inputs, want, ok = (np.concatenate(x) for x in zip(*self.held, strict=True))
            # Mixed, as windows that follow one another are of one text.
            order = np.random.default_rng(self.passed).permutation(len(inputs))
            cuts = [order[a : a + BATCH] for a in range(0, len(order), BATCH)]
            left = cuts.pop() if len(cuts[-1]) < least else order[:0]
            self.held = [(inputs[left], want[left], ok[left])] if len(left) else []
            for p in cuts:
                self.batch = inputs[p], want[p], ok[p]
                next(self.rest)
                self.trained += len(p)

    def batches(self):
        while True:
            yield self.batch

    def parameters(self) -> np.ndarray:
        """All parameters, times the windows trained on, and that number."""
        self.train(1)
        return np.concatenate([*[self.model.weights[k].astype(np.float64).ravel() for k in sorted(self.model.weights)], [1.0]]) * self.trained


def averaged(model: AttentionModel, total: np.ndarray) -> None:
    """Sets the model's parameters to the average that a sum of Learner.parameters holds."""
    if total[-1]:
        at = 0
        for k in sorted(model.weights):
            w = model.weights[k]
            model.weights[k] = (total[at : at + w.size] / total[-1]).reshape(w.shape).astype(w.dtype)
            at += w.size


def _row(names: list[str], kinds: list, n: int, **columns) -> pa.RecordBatch:
    """A batch of n rows that has the columns given, and nulls in the others."""
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names=names)


def _counts(train: DataFrame, content, pattern: str) -> DataFrame:
    """The first pass over the training texts: packed word counts (bucket, block); the ids of texts, and how many each has (texts, many); from each task, counts of ids and, by dimension (slice), what stands around them."""
    buckets = packed.buckets_of(train.sparkSession)
    names = ["bucket", "block", "texts", "many", "ids", "slice", "around"]
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]

    def run(batches):
        sub = _subwords(content.value, pattern)
        vectors = directions(sub.end + 1)
        ids, around = np.zeros(sub.end + 1, np.int64), np.zeros((AROUND, sub.end + 1))
        parts, held = [], 0

        def blocks(parts):
            h, n = _merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            out = np.zeros(len(h), _COUNT)
            out["h"], out["uid"], out["n"] = h, -1, n
            b = packed.packed(mix(h), out, buckets)
            return _row(names, kinds, b.num_rows, bucket=b.column(0), block=b.column(1))

        for _, x in _texts(batches):
            own = np.bincount(x.which, minlength=len(x.hashes))
            got, first = x.sequences(sub)
            ids += np.bincount(got, minlength=len(ids))
            around += contexts(got, first, vectors)
            yield _row(names, kinds, 1, texts=[got.astype(_packed_ids(sub.end)).tobytes()], many=[np.diff(first).astype(np.int64).tobytes()])
            parts.append((x.hashes, own))
            held += len(own)
            if held > 500_000:
                yield blocks(parts)
                parts, held = [], 0
        if parts:
            yield blocks(parts)
        yield _row(names, kinds, 1, ids=[zlib.compress(ids.tobytes(), 1)])
        if ids.any():
            for k, sums in enumerate(around):
                yield _row(names, kinds, 1, slice=[k], around=[zlib.compress(sums.tobytes(), 1)])

    return train.select("text").transform(in_batches, run, "bucket int, block binary, texts binary, many binary, ids binary, slice int, around binary")


def _packed_ids(end: int) -> np.dtype:
    """The type that ids up to ``end`` are written in."""
    return np.dtype("<u2" if end < 1 << 16 else "<i4")


def _learned(sequences: DataFrame, sent, end: int) -> DataFrame:
    """The second pass, over the ids (texts, many): from each task parameters, and counts of ids by the class before them (slice)."""
    names, kinds = ["weights", "slice", "pairs"], [pa.binary(), pa.int32(), pa.binary()]

    def run(batches):
        learner = Learner(sent.value)
        pairs = np.zeros(CLASSES * (end + 1), np.int32)
        for batch in batches:
            for texts, many in zip(batch.column("texts"), batch.column("many"), strict=True):
                got = np.frombuffer(texts.as_buffer(), _packed_ids(end)).astype(np.int32)
                first = np.r_[0, np.cumsum(np.frombuffer(many.as_buffer(), np.int64))]
                add_counts(pairs, learner.model.before(got, first) * (end + 1) + got)
                learner.see(got, first)
        yield _row(names, kinds, 1, weights=[zlib.compress(learner.parameters().tobytes(), 1)])
        pairs = pairs.reshape(CLASSES, end + 1)
        for k in np.flatnonzero(pairs.any(axis=1)).tolist():
            yield _row(names, kinds, 1, slice=[k], pairs=[zlib.compress(pairs[k].astype(np.int64).tobytes(), 1)])

    return sequences.transform(in_batches, run, "weights binary, slice int, pairs binary")


_BINS = 4_096


def _summed(counted: DataFrame) -> DataFrame:
    """(bucket, block, total, words, bins): each bucket's words with their counts, and how many words have each count (from _BINS - 1 on together)."""
    buckets = packed.buckets_of(counted.sparkSession)

    def work(r):
        h, n = _merged(r["h"], r["n"])
        out = np.zeros(len(h), _COUNT)
        out["h"], out["uid"], out["n"] = h, -1, n
        bins = np.bincount(np.minimum(n, _BINS - 1), minlength=_BINS).astype(np.int64)
        b = packed.packed(mix(h), out, buckets)
        last = pa.array([zlib.compress(bins.tobytes(), 1)] + [None] * (b.num_rows - 1), pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([int(n.sum())] + [0] * (b.num_rows - 1), pa.int64()), pa.array([len(h)] + [0] * (b.num_rows - 1), pa.int64()), last], names=["bucket", "block", "total", "words", "bins"])

    return packed.by_bucket(counted, work, _COUNT, "bucket int, block binary, total bigint, words bigint, bins binary")


def _added(rows: DataFrame, column: str, size: int, kind=np.int64, by: str | None = None) -> np.ndarray:
    """Sum of compressed arrays of one size, two levels deep; with ``by`` one sum for each of its CLASSES values."""

    def add(key, table):
        total = np.zeros(size, kind)
        for x in table.column(column):
            total += np.frombuffer(zlib.decompress(x.as_py()), kind)
        return pa.table({"own": pa.array([key[0].as_py()], pa.int32()), column: pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    part = rows.filter(F.col(column).isNotNull()).select(column, (F.col(by) if by else F.lit(0)).alias("own"), F.pmod(F.xxhash64(column), F.lit(8 if by else 64)).alias("part"))
    some = part.groupBy("own", "part").applyInArrow(add, f"own int, {column} binary")
    out = np.zeros((CLASSES if by else 1, size), kind)
    for r in (some.groupBy("own").applyInArrow(add, f"own int, {column} binary") if by else some).collect():  # CLASSES or 64 arrays at most
        out[r["own"]] += np.frombuffer(zlib.decompress(r[column]), kind)
    return out if by else out[0]


def _top(summed: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of count ``least`` or more, sorted by hash, and their counts."""

    def run(batches):
        for batch in batches:
            got = [r[r["n"] >= least].tobytes() for r in (np.frombuffer(x.as_buffer(), _COUNT) for x in batch.column("block"))]
            yield pa.RecordBatch.from_arrays([pa.array([x for x in got if x], pa.binary())], names=["block"])

    rows = summed.select("block").transform(in_batches, run, "block binary").collect()  # TOP words at most
    r = np.concatenate([np.frombuffer(x[0], _COUNT) for x in rows] or [np.zeros(0, _COUNT)])
    return _merged(r["h"], r["n"])


def held_out(key: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text is 2 modulo 7. Null ids are held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 7 == 2, F.lit(True))


def score_texts(docs: DataFrame, held: Column, path: str, pattern: str, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, top: int = TOP, steps: int = STEPS) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; scores are log10 probabilities."""
    spark = prepared(docs.sparkSession)
    sc = spark.sparkContext
    with open(path, "rb") as f:
        content = sc.broadcast(f.read())  # a fixed file below 1 MB
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), held.alias("held"))
    train = rows.filter(~F.col("held"))
    sub = Subwords(content.value, pattern)

    chosen = [r["text"] for r in least_hashed(train.filter(F.octet_length("text") <= SAMPLE_BYTES).select("key", "text"), sample, "key").collect()]
    data, offsets = text_bytes(pa.array(chosen, pa.large_string()))
    got, first = _Texts(data, offsets).sequences(sub)
    counted = written(_counts(few_files(train, rows), content, pattern), "counts", 0)
    ids = _added(counted, "ids", sub.end + 1)
    around = _added(counted, "around", sub.end + 1, np.float64, "slice")[:AROUND]
    model = AttentionModel.begin(ids, np.array([sub.encoding.decode_single_token_bytes(i)[:1] == b" " for i in range(sub.end)] + [True]), around)
    if chosen:
        model.train(got, first, steps)
    begun = sc.broadcast(model)
    sequences = counted.filter("texts is not null").select("texts", "many")
    learned = written(_learned(few_files(sequences, rows), begun, sub.end), "learned", 0)
    averaged(model, _added(learned, "weights", sum(w.size for w in model.weights.values()) + 1, np.float64))
    model.learn_shares(ids, _added(learned, "pairs", sub.end + 1, by="slice"))
    begun.destroy()
    texts = int(ids[-1])
    summed = written(_summed(counted.filter("bucket is not null").select("bucket", "block")), "words", 0)
    said = summed.agg(F.sum("total").alias("n"), F.sum("words").alias("v")).first()
    total, distinct = (said["n"] or 0) + texts, (said["v"] or 0) + (texts > 0)
    bins = _added(summed, "bins", _BINS)
    more = np.cumsum(bins[::-1])[::-1]  # words of a count or more; words over the last bin are fewer than TOP in any corpus of natural text
    least = int(np.argmax(more <= top)) if (more <= top).any() else None
    words_, counts_ = _top(summed, max(least, 1)) if least is not None else (np.zeros(0, U64), np.zeros(0, np.int64))
    floor = total + distinct + 1

    sent = sc.broadcast((model, words_, counts_, floor, texts, least))
    buckets = packed.buckets_of(spark)
    # On the way back each bucket writes a block for each of these: one for a partition is enough.
    back_buckets = buckets // packed.BUCKETS
    names = ["uid", "key", "held", "n_tokens", "known", "base", "score", "bucket", "block"]
    kind = rows.schema["key"].dataType

    def scored(batches):
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        sub = _subwords(content.value, pattern)
        model, top_h, top_n, floor, texts, least = sent.value
        for batch, x in _texts(batches):
            m = batch.num_rows
            at = np.searchsorted(top_h, x.hashes)
            hit = (top_h[np.minimum(at, len(top_h) - 1)] == x.hashes) if len(top_h) else np.zeros(len(x.hashes), bool)
            log = np.zeros(len(x.hashes))
            log[hit] = np.log10((top_n[at[hit]] + 1) / floor)
            sums = np.r_[0, np.cumsum(log[x.which])]
            seen = np.r_[0, np.cumsum(hit[x.which])]
            base = sums[x.first[1:]] - sums[x.first[:-1]] + np.log10((texts + 1) / floor)
            known = seen[x.first[1:]] - seen[x.first[:-1]] + (texts > 0)
            ids, first = x.sequences(sub)
            log10 = model.score(ids, first) / np.log(10)
            own = pa.array(uid + np.arange(m))
            none = [pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())]
            yield pa.RecordBatch.from_arrays([own, batch.column("key"), batch.column("held"), pa.array(np.diff(x.first) + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(log10), *none], names=names)
            rare = np.flatnonzero(~hit[x.which])
            text = np.searchsorted(x.first, rare, "right") - 1
            pairs, n = np.unique(text * len(x.hashes) + x.which[rare], return_counts=True)
            out = np.empty(len(pairs), _COUNT)
            out["h"], out["uid"], out["n"] = x.hashes[pairs % max(len(x.hashes), 1)], uid + pairs // max(len(x.hashes), 1), n
            b = packed.packed(mix(out["h"].astype(U64)), out, buckets)
            yield pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, t) for t in (pa.int64(), batch.column("key").type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())] + b.columns, names=names)
            uid += m

    done = written(few_files(rows, rows).transform(in_batches, scored, f"uid bigint, key {kind.simpleString()}, held boolean, n_tokens bigint, known bigint, base double, score double, bucket int, block binary"), "scores", 0)

    def rare(r):
        count = r[r["uid"] < 0]
        asked = r[r["uid"] >= 0]
        count = count[np.argsort(count["h"], kind="stable")]
        at = np.searchsorted(count["h"], asked["h"])
        there = (count["h"][np.minimum(at, len(count) - 1)] == asked["h"]) if len(count) else np.zeros(len(asked), bool)
        c = np.where(there, count["n"][np.minimum(at, max(len(count) - 1, 0))], 0) if len(count) else np.zeros(len(asked), np.int64)
        out = np.empty(len(asked), _SUM)
        out["uid"], out["base"], out["known"] = asked["uid"], asked["n"] * np.log10((c + 1) / floor), np.where(there, asked["n"], 0)
        yield from sums(out)

    def sums(r, pack=True):
        r = r[np.argsort(r["uid"], kind="stable")]
        at = np.flatnonzero(np.r_[True, r["uid"][1:] != r["uid"][:-1]]) if len(r) else np.zeros(0, np.int64)
        out = np.empty(len(at), _SUM)
        if len(at):
            out["uid"], out["base"], out["known"] = r["uid"][at], np.add.reduceat(r["base"], at), np.add.reduceat(r["known"], at)
        if pack:
            yield packed.packed(mix(out["uid"].astype(np.int64).view(U64)), out, back_buckets)
        else:
            yield pa.RecordBatch.from_arrays([pa.array(out["uid"]), pa.array(out["base"]), pa.array(out["known"])], names=["uid", "more_base", "more_known"])

    open_ = done.filter("bucket is not null").select("bucket", "block").unionByName(summed.select("bucket", "block"))
    partial = packed.by_bucket(open_, rare, _COUNT, "bucket int, block binary")
    back = packed.by_bucket(partial, lambda r: sums(r, False), _SUM, "uid bigint, more_base double, more_known bigint")
    out = done.filter("uid is not null").join(back, "uid", "left")
    zero = F.lit(0)
    out = out.select(F.col("key").alias(key), F.col("held").alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more_known", zero)).alias("n_known"), F.lit(int(total)).cast("bigint").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score")
    return few_files(out, rows)
