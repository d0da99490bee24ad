import random

import numpy as np
import pytest

from arcwise.llm import suffix_dedup, suffix_groups
from tests.llm import brute
from tests.llm.test_text_operators import documents, sorted_rows


@pytest.mark.parametrize("symbols", [1, 2, 3, 6])
def test_suffix_arrays(symbols):
    r = random.Random(symbols)
    for _ in range(60):
        n = r.randrange(1, 45)
        rows = [[r.randrange(1, symbols + 1) for _ in range(n - 1)] + [0] for _ in range(4)]
        table = np.zeros((4, n + r.randrange(3)), np.uint8)
        table[:, :n] = rows
        for t, got in zip(rows, suffix_groups.sort_many(table), strict=True):
            want = sorted(range(n), key=lambda i: t[i:])
            assert [i for i in got if i < n][: n] == want or [i for i in got if i < n - 1] == [i for i in want if i < n - 1]
            assert suffix_groups.sort_one(t) == want


def removed(docs, length=50):
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - length + 1) if d is not None else ():
            s = b[i : i + length]
            first[s] = min(d, first.get(s, d))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        hit = bytearray(len(b))
        for i in range(len(b) - length + 1) if d is not None else ():
            if first[b[i : i + length]] < d:
                hit[i : i + length] = b"\1" * length
        spans = bytes(hit).replace(b"\0", b" ").split()
        out.append((d, len(b), sum(hit), len(spans), brute.sha(bytes(x for x, h in zip(b, hit, strict=True) if not h))))
    return sorted(out, key=str)


def planted(seed=4):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh éß") for _ in range(r.randrange(1, 9)))
    shared = [" ".join(word() for _ in range(r.randrange(8, 60))) for _ in range(6)]
    out = []
    for d in range(60):
        parts = [" ".join(word() for _ in range(r.randrange(0, 30))) for _ in range(3)]
        for _ in range(r.randrange(0, 3)):
            s = r.choice(shared)
            a = r.randrange(0, len(s) // 2)
            parts.insert(r.randrange(len(parts)), s[a : a + r.randrange(30, len(s))])
        out.append((3000 + r.randrange(1000), "".join(parts)))
    return out + [(5000, "a" * 300), (5001, "a" * 170), (5002, "ab" * 100), (5003, "ab" * 70 + "c"), (4999, "x" + "a" * 49), (5004, out[0][1][:49])]


def test_dedup_equals_brute_force(spark, tables, monkeypatch):
    docs = [*documents(spark, tables)[:120], *brute.ODD, *planted()]
    seen = set()
    docs = [(d, t) for d, t in docs if not ((d, t) in seen or seen.add((d, t)))] + [(9, brute.ODD[8][1])]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id bigint, text string, spans string")
    want = removed(docs)
    assert sum(w[2] > 0 for w in want) > 30
    assert sorted_rows(suffix_dedup.suffix_digest(df)) == want
    assert suffix_dedup.suffix_digest(df.limit(0)).count() == 0


def test_pieces_and_paths_agree(monkeypatch):
    import pyarrow as pa

    r = np.random.default_rng(1)
    text = bytes(r.integers(97, 101, 5000).astype(np.uint8)).decode() + "é" * 200
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([text]), pa.array([1], pa.int32())], names=["doc", "text", "kind"])

    def strings():
        return {(int(h), int(a) + k) for _, _, _, at, hs, _, n, _ in suffix_dedup._pieces([batch], 50, 20) for h, a, m in zip(hs, at, n, strict=True) for k in range(m)}

    whole = strings()
    assert len(whole) == len(text.encode()) - 49
    monkeypatch.setattr(suffix_dedup, "_PIECE", 333)
    assert strings() == whole
    data = np.frombuffer(text.encode(), np.uint8)
    groups = [(np.array([0, 40, 5200]), np.array([30, 64, 20]), np.array([3, 2, 5])), (np.array([5000, 5200]), np.array([60, 64]), np.array([9, 1]))]
    monkeypatch.setattr(suffix_dedup, "_ROWS", 1)
    one = suffix_dedup.least_ids(groups, data, 50)
    monkeypatch.setattr(suffix_dedup, "_ALONE", 10)
    assert all(np.array_equal(a, b) for a, b in zip(one, suffix_dedup.least_ids(groups, data, 50), strict=True))


def dealt_batches(docs, rows, more=()):
    """Dealt rows as Arrow batches of ``rows`` rows; docs: (deal, doc, text), more: (part, bucket, bytes)."""
    import pyarrow as pa

    said = [(part >> suffix_dedup._PART_BITS, None, None, part, bucket, x) for part, bucket, x in more]
    table = sorted([*said, *[(deal, d, t, None, None, None) for deal, d, t in docs]], key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or ""))
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary()]
    for a in range(0, len(table), rows):
        yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*table[a : a + rows], strict=True), kinds, strict=True)], names=["deal", "doc", "text", "part", "bucket", "more"])


def test_parts_are_cut_alike_whatever_the_batches(monkeypatch):
    r = random.Random(2)
    docs = [(deal, d, "é" * r.randrange(0, 90)) for deal in (0, 1, 3) for d in range(40)] + [(3, 41, "x" * 5000), (3, 42, "")]
    monkeypatch.setattr(suffix_dedup, "_PART", 700)
    more = [(deal << suffix_dedup._PART_BITS | k, 5, b"%d %d" % (deal, k)) for deal in (0, 3) for k in range(4)]
    plain = lambda rows: [(int(p), d.tolist(), o.tolist(), bytes(x), list(s)) for p, d, o, x, s in suffix_dedup._parts(dealt_batches(docs, rows, more))]
    want = plain(1000)
    assert len(want) > 15 and [d for _, ids, *_ in want for d in ids] == [d for _, d, _ in sorted(docs)]
    assert b"".join(x for *_, x, _ in want).decode() == "".join(t for _, _, t in sorted(docs))
    assert all(s == [m[1:] for m in more if m[0] == p] for p, *_, s in want)
    assert plain(1) == plain(7) == want


def test_only_fragments_that_have_company_travel(spark):
    """What travels follows from the fragments' own company, exactly, so that it doesn't rise with the size of the table."""
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    shared, copied = text(200), text(3000)
    docs = [(d, text(r.randrange(100, 9000))) for d in range(150)] + [(200 + d, text(100) + shared + text(100)) for d in range(5)] + [(300, copied), (301, copied)]
    rows = spark.createDataFrame(docs, "doc bigint, text string").repartition(3)
    met = suffix_dedup._met(suffix_dedup._dealt(rows, 3), 3, 50, 20)
    went = suffix_dedup._travelling(suffix_dedup._dealt(rows, 3, met), 3, 50, 20).collect()
    keys, kinds = {}, {}
    for *_, doc, _, place, h, n, f in suffix_dedup._fragments(dealt_batches([(0, d, t) for d, t in docs], 50), 50, 20):
        for key, d, m, kind in zip((h >> np.uint64(24)).tolist(), doc.tolist(), n.tolist(), f.tolist(), strict=True):
            keys.setdefault(key, []).append((d, m))
            kinds.setdefault(key, set()).add(kind)
    got = np.concatenate([np.frombuffer(x["places"], suffix_dedup._PLACE) for x in went])
    want = sorted(x for key, own in keys.items() if len(own) > 1 for x in own)
    assert 100 < len(want) < sum(map(len, keys.values())) / 20
    assert sorted(zip(got["doc"].tolist(), got["n"].tolist(), strict=True)) == want
    assert sum(x["known"] for x in went) == sum(len(own) for key, own in keys.items() if len(kinds[key]) > 1)
    assert sum(len(x["bytes"]) for x in went) == sum(m + 49 for key, own in keys.items() if len(kinds[key]) > 1 for _, m in own)
