import collections
import math
import re

import numpy as np
import public_tokenizers as P
import pyarrow as pa

from arcwise.llm import language_model as lm, queries
from arcwise.llm.blocks import text_bytes
from tests.llm import brute
from tests.llm.test_text_operators import documents


def tokens(t):
    return re.findall(rb"[^\x20\x09-\x0d]+", brute.lower(t).encode()) + [b"\n"]


def expected(docs):
    counts = collections.Counter(w for d, t in docs if d is not None and brute.crc(d, 7) != 2 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, t in docs:
        w = tokens(t)
        out.append((d, d is None or brute.crc(d, 7) == 2, len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)))
    return sorted(out, key=str)


def scored(df, **options):
    return lm.score_texts(df, lm.held_out(), queries.RANKS, P.PATTERN, **options)


def test_base_equals_brute_force_and_model_beats_it(spark, tables):
    # Two words of 1024 letters to which a polynomial modulo 2**64 gives one hash: only one of them is learned from.
    morse = ["".join(two[bin(i).count("1") & 1] for i in range(1024)) for two in ("ab", "ba")]
    seen, unseen = (next(d for d in range(200_000, 200_100) if (brute.crc(d, 7) == 2) == held) for held in (False, True))
    docs = [*documents(spark, tables), *[(d and d + 100_000, t) for d, t in brute.ODD], (seen, morse[0]), (unseen, f"{morse[1]} {morse[0]}")]
    df = spark.createDataFrame([(d, t, 0.5) for d, t in docs], "doc_id bigint, text string, score double")
    want = expected(docs)
    for top in (lm.TOP, 50):
        rows = sorted(scored(df, top=top, steps=150 if top == 50 else lm.STEPS).collect(), key=lambda r: str(tuple(r)[:5] + (round(r["base_score"], 4),)))
        assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted((w[:5] for w in want), key=str)
        assert np.allclose(sorted(r["base_score"] for r in rows), sorted(w[5] for w in want), rtol=1e-9)
        if top == lm.TOP:
            # Against single ids by their share in the training texts: what stands before an id must help.
            sub = lm.Subwords(open(queries.RANKS, "rb").read(), P.PATTERN)

            def sequence(t):
                x = lm._Texts(*text_bytes(pa.array([t or ""])))
                return x.sequences(sub)[0]

            counts = sum(np.bincount(sequence(t), minlength=sub.end + 1) for d, t in docs if d is not None and brute.crc(d, 7) != 2) + 0.5
            plain = {d: np.log10(counts[sequence(t)] / counts.sum()).sum() for d, t in docs}
            held = [r for r in rows if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 100_000]
            assert sum(r["score"] for r in held) > 0.8 * sum(plain[r["doc_id"]] for r in held)
    assert scored(df.limit(0)).count() == 0


def small_model(seed=0):
    r = np.random.default_rng(seed)
    counts = r.integers(0, 50, 300)
    return lm.AttentionModel.begin(counts, np.arange(300) % 2)


def test_probabilities_sum_to_one_and_each_id_is_scored_once():
    m = small_model()
    assert math.isclose(sum(np.bincount(m.classes, weights=np.exp(m.share))), len(np.unique(m.classes)))
    ids = np.random.default_rng(1).integers(0, 300, 500).astype(np.int32)
    first = np.array([0, 1, 30, 30 + 24, 500])
    inputs, at = m.windows(ids, first)
    assert sorted(at[at >= 0]) == list(range(500))
    one = m.score(ids, first)
    logp = m.forward(inputs)[-1]
    total = np.zeros(500)
    ok = at >= 0
    total[at[ok]] = np.take_along_axis(logp, m.classes[ids[np.maximum(at, 0)]][:, :, None], 2)[:, :, 0][ok] + m.share[ids[at[ok]]]
    assert np.allclose(one, np.add.reduceat(total, first[:-1]), rtol=1e-4)
    assert np.allclose(one, m.score(ids, first, batch=3), rtol=1e-5)
    # Large numbers on the way change nothing but the numbers.
    m.weights["b"] += 500
    assert np.allclose(one, m.score(ids, first), rtol=1e-3)
    m.weights["b"] -= 1000
    assert np.allclose(one, m.score(ids, first), rtol=1e-3)


def test_shares_by_the_class_before():
    m = small_model(6)
    r = np.random.default_rng(6)
    ids, first = r.integers(0, 300, 5000).astype(np.int32), np.array([0, 0, 2, 900, 5000])
    counts = np.bincount(ids, minlength=300)
    pairs = np.zeros((lm.CLASSES, 300), np.int64)
    for t in range(4):
        last = m.classes[m.end]
        for i in ids[first[t] : first[t + 1]]:
            pairs[last, i] += 1
            last = m.classes[i]
    plain = m.score(ids, first).sum()
    m.learn_shares(counts, pairs)
    assert np.allclose([np.bincount(m.classes, weights=np.exp(row), minlength=lm.CLASSES)[np.unique(m.classes)] for row in m.given], 1, atol=1e-3)
    k = m.before(ids, first)
    assert k[0] == k[2] == k[900] == m.classes[m.end] and k[3] == m.classes[ids[2]]
    smooth = np.exp(m.share)
    for at in (0, 5, 4999):
        own = pairs[k[at]]
        want = (own[ids[at]] + lm.PRIOR * smooth[ids[at]]) / (own[m.classes == m.classes[ids[at]]].sum() + lm.PRIOR)
        assert math.isclose(m.shares(ids, first)[at], math.log(want), rel_tol=1e-4)
    assert m.score(ids, first).sum() > plain


def test_learners_see_their_share_of_the_windows_and_are_averaged():
    m = small_model(7)
    r = np.random.default_rng(7)
    texts = [(r.integers(0, 300, n).astype(np.int32), np.array([0, n // 3, n])) for n in (30, 5000, 1, 2000, 40_000)]
    one, other = lm.Learner(m), lm.Learner(m)
    for ids, first in texts:
        one.see(ids, first)
    windows = sum(len(m.windows(*t)[0]) for t in texts)
    total = one.parameters()
    assert one.passed == windows and total[-1] == one.trained == -(-windows // lm.EVERY)
    other.see(*texts[1])
    both = total + other.parameters()
    mean = small_model(7)
    lm.averaged(mean, both)
    for k in m.weights:
        want = (one.model.weights[k] * float(one.trained) + other.model.weights[k] * float(other.trained)) / (one.trained + other.trained)
        assert np.allclose(mean.weights[k], want, atol=1e-5) and not np.array_equal(mean.weights[k], m.weights[k])
    lm.averaged(m, np.zeros_like(both))  # nothing learned: as it was
    assert np.array_equal(m.weights["W"], small_model(7).weights["W"])


def test_scores_are_causal():
    m = small_model(2)
    ids = np.random.default_rng(2).integers(0, 300, 200).astype(np.int32)
    parts = [m.score(ids[:n], np.array([0, n]))[0] for n in (100, 200)]
    other = ids.copy()
    other[100:] = 7
    inputs, at = m.windows(ids, np.array([0, 200]))
    inputs2, _ = m.windows(other, np.array([0, 200]))
    a, b = m.forward(inputs)[-1], m.forward(inputs2)[-1]
    early = (at >= 0) & (at <= 100)
    assert np.allclose(a[early], b[early]) and parts[1] < parts[0]


def test_training_finds_what_follows():
    m = small_model(3)
    ids = np.tile(np.array([5, 9, 5, 9, 11], np.int32), 400)
    first = np.arange(0, 2001, 100)
    before = m.score(ids, first).sum()
    assert m.train(ids, first, steps=150) < 0.5
    assert m.score(ids, first).sum() > before


def test_gradients_equal_differences():
    m = small_model(4)
    m.weights = {k: x.astype(np.float64) for k, x in m.weights.items()}
    ids = np.random.default_rng(5).integers(0, 300, 60).astype(np.int32)
    inputs, at = m.windows(ids, np.array([0, 10, 60]))
    data = (inputs, *m.wanted(ids, at))
    _, g = m.gradients(*data)
    r = np.random.default_rng(8)
    for name, w in m.weights.items():
        some = np.argwhere(g[name] != 0)
        for place in some[r.integers(0, len(some), 6)]:
            place, had = tuple(place), w[tuple(place)]
            loss = []
            for step in (1e-5, -1e-5):
                w[place] = had + step
                loss.append(m.gradients(*data)[0])
            w[place] = had
            assert math.isclose((loss[0] - loss[1]) / 2e-5, g[name][place], rel_tol=1e-4, abs_tol=1e-8), name


def test_words_with_odd_spaces_are_encoded_one_by_one():
    sub = lm.Subwords(open(queries.RANKS, "rb").read(), P.PATTERN)
    for strings in (["a", " b", " ", "don't,", "été"], ["plain", "words"]):
        ids, many = sub.encode(strings)
        assert [ids[e - n : e].tolist() for e, n in zip(np.cumsum(many), many, strict=True)] == [sub.encoding.encode_ordinary(f" {s}") for s in strings]


def test_classes_and_training_take_all_training_texts(spark, monkeypatch):
    """Whatever the sample that the first parameters come from: counts, contexts and windows are those of all training texts."""
    r = np.random.default_rng(11)
    words = [f"w{i}" for i in range(300)]
    docs = [(d, " ".join(r.choice(words, r.integers(1, 120)))) for d in range(80)] + [(80, None), (81, "")]
    sub = lm.Subwords(open(queries.RANKS, "rb").read(), P.PATTERN)
    sequences = [lm._Texts(*text_bytes(pa.array([t or ""]))).sequences(sub)[0] for d, t in docs if brute.crc(d, 7) != 2]
    seen = {}
    begin, averaged = lm.AttentionModel.begin.__func__, lm.averaged
    monkeypatch.setattr(lm.AttentionModel, "begin", classmethod(lambda cls, counts, flags, around: seen.update(counts=counts, around=around) or begin(cls, counts, flags, around)))
    monkeypatch.setattr(lm, "averaged", lambda model, total: seen.update(windows=total[-1]) or averaged(model, total))
    assert scored(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), sample=2, steps=5).count() == len(docs)
    assert np.array_equal(seen["counts"], sum(np.bincount(s, minlength=sub.end + 1) for s in sequences))
    assert seen["windows"] == sum(-(-len(s) // lm.STRIDE) for s in sequences)
    vectors, want = lm.directions(sub.end + 1), np.zeros((lm.AROUND, sub.end + 1))
    for s in sequences:
        for a in range(0, len(s), lm.BESIDE):
            piece = vectors[s[a : a + lm.BESIDE]].astype(float)
            for i, own in zip(s[a : a + lm.BESIDE], piece, strict=True):
                want[:, i] += (piece.sum(axis=0) - own) / max(len(piece) - 1, 1)
    assert np.allclose(seen["around"], want, atol=1e-3)


def test_gradients_of_a_step_are_taken_in_blocks(monkeypatch):
    """A step's batch is handled in blocks that stay in cache, and its gradients are those of the batch at once, also where places aren't scored or numbers are large."""
    m = small_model(9)
    r = np.random.default_rng(9)
    ids, first = r.integers(0, 300, 9000).astype(np.int32), np.array([0, 5, 700, 9000])
    inputs, at = m.windows(ids, first)
    data = (inputs, *m.wanted(ids, at))
    sizes, add = [], lm.AttentionModel._add_gradients
    monkeypatch.setattr(lm.AttentionModel, "_add_gradients", lambda self, e, *rest: sizes.append(len(e)) or add(self, e, *rest))
    for gain in (1, 40):
        m.weights["Q"] *= gain
        monkeypatch.setattr(lm, "BLOCK", len(inputs))
        loss, whole = m.gradients(*data)
        monkeypatch.setattr(lm, "BLOCK", 64)
        sizes.clear()
        other, g = m.gradients(*data)
        assert max(sizes) == 64 and sum(sizes) == len(inputs) and math.isclose(loss, other, rel_tol=1e-5)
        assert math.isclose(loss, -np.take_along_axis(m.forward(inputs)[-1], data[1][:, :, None], 2)[:, :, 0][data[2]].mean(), rel_tol=1e-4)
        assert all(np.abs(g[k] - whole[k]).max() < 1e-4 * np.abs(whole[k]).max() for k in m.weights)


def test_sums_and_counts_taken_in_bulk():
    r = np.random.default_rng(10)
    for n in (0, 1, 5, 3000):
        row, values = (40 * r.random(n) ** 3).astype(np.int64), r.normal(size=(n, lm.DIM)).astype(np.float32)
        want = np.zeros((50, lm.DIM))
        np.add.at(want, row, values)
        assert np.allclose(lm.sums_by_row(row, values, 50), want, atol=1e-3)
        counts, other = np.zeros(50, np.int32), np.zeros(50, np.int32)
        for _ in range(2):
            lm.add_counts(counts, row)
            np.add.at(other, row, 1)
        assert np.array_equal(counts, other)
    starts = np.array([0, 1, 9, 18, 400])
    which = r.integers(0, 3000, 500)
    assert np.allclose(lm.row_sums(values, which, starts), np.add.reduceat(values[which], starts, axis=0), atol=1e-3)


def test_gradients_and_scores_of_any_number_of_windows_and_any_bias():
    """Windows are multiplied in groups and the bias is left out of the large arrays: neither changes a result."""
    r = np.random.default_rng(12)
    ids, first = r.integers(0, 300, 3000).astype(np.int32), np.array([0, 1, 1, 49, 3000])
    for shift in (0, 500, -500, "spread"):
        m = small_model(12)
        m.weights["b"] += r.normal(size=lm.CLASSES).astype(np.float32) * 60 if shift == "spread" else shift
        inputs, at = m.windows(ids, first)
        logp = m.forward(inputs)[-1]
        named = np.take_along_axis(logp, m.classes[ids[np.maximum(at, 0)]][:, :, None], 2)[:, :, 0]
        for n in (1, 3, 4, 65, len(inputs)):
            data = (inputs[:n], *m.wanted(ids, at[:n]))
            loss, g = m.gradients(*data)
            assert math.isclose(loss, -named[:n][at[:n] >= 0].mean(), rel_tol=1e-3) and all(np.isfinite(x).all() for x in g.values())
            grown = np.exp(logp[:n])[at[:n] >= 0].sum(axis=0) - np.bincount(m.classes[ids[at[:n][at[:n] >= 0]]], minlength=lm.CLASSES)
            assert np.allclose(g["b"], grown / (at[:n] >= 0).sum(), atol=1e-4)
        total = np.zeros(len(ids))
        total[at[at >= 0]] = named[at >= 0]
        assert math.isclose(m.score(ids, first).sum(), (total + m.share[ids]).sum(), rel_tol=1e-3)
