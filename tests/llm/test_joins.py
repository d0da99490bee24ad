import random

from arcwise.llm import jaccard_join, line_dedup
from arcwise.operators import traversal as components
from tests.llm import brute
from tests.llm.test_text_operators import documents, sorted_rows


def varied(n=60, words=50, seed=3):
    """Groups of copies, near copies and chains of edits."""
    r = random.Random(seed)
    out = []
    for g in range(6):
        base = [f"w{g}x{i}" for i in range(words)]
        for k in range(n // 6):
            t = base[:]
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                t[r.randrange(words)] = f"e{r.randrange(30)}"
            if g % 2:
                base = t
            out.append((1000 + g * 100 + k, " ".join(t[: words - r.choice([0, 0, 3])])))
    return out


def test_components(spark):
    r = random.Random(5)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    want = brute.components({x for p in links for x in p}, links)
    got = {x["node"]: x["component"] for x in components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {k: v for k, v in want.items() if k in got} and {k for k, v in want.items() if k != v} <= set(got)
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_jaccard_equals_brute_force(spark, tables):
    docs = [*documents(spark, tables), *brute.ODD, *varied()]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id bigint, text string, n_shingles string")
    want = brute.jaccard_components(docs)
    assert sum(c != d for d, _, c in want) >= 20
    assert sorted_rows(jaccard_join.shingle_components(df)) == want
    assert jaccard_join.shingle_components(df.limit(0)).count() == 0


def test_jaccard_bound_holds():
    import numpy as np

    r = np.random.default_rng(1)
    for _ in range(300):
        n, m, o = r.integers(1, 400), r.integers(1, 400), r.integers(0, 200)
        both = r.integers(0, 2**63, o, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, r.integers(0, 2**63, k, dtype=np.uint64)])) for k in (n, m))
        overlap = len(np.intersect1d(a, b))
        assert (len(a) + len(b) - jaccard_join.differing(jaccard_join.bitmap(a), jaccard_join.bitmap(b))) // 2 >= overlap


def line_docs(n=40, seed=11):
    r = random.Random(seed)
    lines = [" ".join(r.choice("abcdefghijklmnopqrst") * r.randrange(1, 4) for _ in range(r.randrange(1, 40))) for _ in range(60)]
    out = []
    for d in range(n):
        own = []
        for _ in range(r.randrange(1, 9)):
            w = r.choice(lines).split(" ")
            for _ in range(r.choice([0, 0, 1, 2])):
                w[r.randrange(len(w))] = r.choice(["zz", "Yy", "xx"]) + str(r.randrange(9))
            own.append(" ".join(w))
        out.append((2000 + d, r.choice(["\n", "\n\n", "\r\n"]).join(own)))
    return out


def expected_lines(docs):
    gone = brute.repeated_lines(docs)
    out = []
    for d, t in docs:
        lines = [] if t is None else t.split("\n")
        cut = [i for i in range(len(lines)) if (d, i) in gone]
        out.append((d, len(lines), len(cut), brute.sha("\n".join(x for i, x in enumerate(lines) if i not in cut))))
    return sorted(out, key=str)


def test_line_dedup_equals_brute_force(spark, tables, monkeypatch):
    docs = [*documents(spark, tables), *brute.ODD, *line_docs(), (9, "same text of more than five words STANDS here twice\nx"), (9000, "\n" * 50 + "\n".join(t for _, t in line_docs(90, 5)))]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id bigint, text string, n_lines string")
    want = expected_lines(docs)
    assert sum(n for _, _, n, _ in want) > 100
    assert sorted_rows(line_dedup.line_digest(df)) == want
    monkeypatch.setattr(line_dedup, "FEW", 1)  # so that lines stay open
    assert sorted_rows(line_dedup.line_digest(df.repartition(3))) == want
    assert line_dedup.line_digest(df.limit(0)).count() == 0
    want = brute.repeated_lines(docs, min_words=5)
    assert {tuple(r) for r in line_dedup.repeated_lines(df, min_words=5).collect()} == want


def test_words_that_a_sum_of_places_takes_for_one(spark):
    """Thue-Morse words and their complements: a polynomial modulo 2**64 gives both one hash."""
    import numpy as np

    from arcwise.llm.blocks import window_hashes, word_hashes

    for n in (4, 8, 9, 64, 65, 1024, 4096):
        a = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
        b = "".join("ba"[bin(i).count("1") & 1] for i in range(n))
        data = np.frombuffer(f"{a} {b} {a.upper()}".encode(), np.uint8)
        x = word_hashes(data, np.array([0, n + 1, 2 * n + 2]), np.array([n, 2 * n + 1, 3 * n + 2]))
        assert x[0] == x[2] != x[1]
    docs = [(1, a), (2, b), (3, f"{a}\n{b}"), (4, f"one {a} two three"), (5, f"one {b} two three")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert sorted_rows(jaccard_join.shingle_components(df)) == brute.jaccard_components(docs)
    assert {tuple(r) for r in line_dedup.repeated_lines(df).collect()} == brute.repeated_lines(docs)
    # Sequences of two words, as windows have them.
    h = np.array([5, 9], np.uint64)[[bin(i).count("1") & 1 for i in range(64)]]
    assert len(set(window_hashes(h, np.array([0, 32, 64]), 32)[0].tolist())) == 2


def test_very_many_repeated_lines_in_one_document(spark):
    n, line = 100_000, "the same line of words"
    docs = [(1, "\n".join([line] * n)), (2, f"{line}\nother"), (3, "\n".join(f"{line} and {i} more of {i * 7}" for i in range(300)))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = sorted_rows(line_dedup.line_digest(df.repartition(2)))
    assert got[:2] == [(1, n, n - 1, brute.sha(line)), (2, 2, 1, brute.sha("other"))]
    gone = brute.repeated_lines(docs[2:])
    assert got[2][2] == len(gone) > 0


def test_lines_are_looked_up_or_joined_alike(spark, monkeypatch):
    from arcwise.llm import shared

    df = spark.createDataFrame(line_docs(20, 9), "doc_id bigint, text string")
    small = line_dedup.line_digest(df)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    rows = sorted_rows(small)
    monkeypatch.setattr(shared, "LOOKUP_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = line_dedup.line_digest(df)
        assert "SortMergeJoin" in large._jdf.queryExecution().executedPlan().toString() and sorted_rows(large) == rows
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_line_dedup_keeps_columns_of_any_name(spark):
    text = "one line of words\nsecond line here"
    df = spark.createDataFrame([(1, text, 5, 6, 7, 8), (2, text, 5, 6, 7, 8)], "doc_id bigint, text string, _doc int, _gone int, `a.b` int, _bits int")
    rows = sorted(line_dedup.drop_repeated_lines(df).collect())
    assert [tuple(r) for r in rows] == [(1, text, 5, 6, 7, 8, 2, 0), (2, "", 5, 6, 7, 8, 2, 2)]


def test_sets_that_differ_in_late_bits_only():
    import numpy as np

    x = np.array([1 << 50, (1 << 50) + 1, 7, 1 << 50, (1 << 50) + 2], np.uint64)
    y = np.array([1 << 50, (1 << 50) + 2, 7, (1 << 50) + 1, 3], np.uint64)
    assert line_dedup._common(x, np.array([3, 2]), y, np.array([3, 2])).tolist() == [2, 0]


def test_short_and_unspaced_lines_equal_brute_force(spark, tmp_path):
    from arcwise.llm.queries import op6_line_dedup

    docs = [*brute.ODD, *line_docs(30, 3)]
    docs += [(700 + i, f"All rights reserved.\n}} \n版权所有不得转载本文内容\nhttps://example.org/{i}/a/long/path\na b c d\na b c d x{i}\n\nreserved ALL rights.") for i in range(6)]
    df = spark.createDataFrame([(d, t) for d, t in docs], "doc_id bigint, text string")
    gone = brute.repeated_lines(docs)
    assert {(703, i) for i in (0, 1, 2, 4, 5, 7)} <= gone and not {(703, 3), (703, 6)} & gone
    assert {tuple(r) for r in line_dedup.repeated_lines(df).collect()} == gone
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert op6_line_dedup(spark, str(tmp_path)).agg({"n_removed": "sum"}).first()[0] == sum((d, i) in gone for d, t in docs if t for i in range(len(t.split("\n"))))


def test_long_texts_in_pieces_give_the_same_lines(monkeypatch):
    import pyarrow as pa

    text = "\n".join(f"line {i} has words number {i * 7} and {i * i} more" for i in range(300)) + "\n\ntail of the text has words too"
    batch = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([text])], names=["doc", "text"])
    monkeypatch.setattr(line_dedup, "chunks", lambda o: [(0, 1)])

    def sets():
        return [(int(n), x.h[s : s + k].tolist()) for _, x in line_dedup._blocks([batch], 5) for n, s, k in zip(x.number, x.starts, x.sizes, strict=True)]

    whole = sets()
    assert len(whole) == 301
    for size in (40, 100, 1000, len(text) - 5):
        monkeypatch.setattr(line_dedup, "_LONG", size)
        assert sets() == whole


def test_hash_equals_sparks(spark):
    import numpy as np

    x = np.array([0, 1, -1, 2**62, -(2**63), 12345678901], np.int64)
    want = [r[0] for r in spark.createDataFrame([(int(v),) for v in x], "v bigint").selectExpr("xxhash64(v)").collect()]
    assert line_dedup._xxhash64(x).tolist() == want


def test_no_similar_pair_across_components_is_lost():
    import numpy as np

    r = np.random.default_rng(4)
    rows = []
    for g in range(5):
        base = r.integers(0, 2**63, r.integers(5, 200), dtype=np.uint64)
        for _ in range(12):
            cut = base[r.random(len(base)) > r.choice([0, 0.02, 0.1])]
            rows.append((g, np.unique(np.concatenate([cut, r.integers(0, 2**63, r.integers(0, 1 + len(base) // 8), dtype=np.uint64)])), int(r.integers(0, 3))))
    rows.sort(key=lambda x: (x[0], len(x[1])))
    n = np.array([len(s) for _, s, _ in rows])
    part = np.array([c for _, _, c in rows])
    want = set()
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            overlap = len(np.intersect1d(rows[i][1], rows[j][1]))
            if rows[i][0] == rows[j][0] and part[i] != part[j] and overlap >= jaccard_join.least_overlap(n[i], n[j], 85):
                want.add((i, j))
    call = lambda nearest: {(int(x), int(y)) for a, b in jaccard_join._crossing(np.arange(len(rows)), n, part, np.array([g for g, _, _ in rows]), [jaccard_join.bitmap(s) for _, s, _ in rows], 85, nearest) for x, y in zip(a, b, strict=True)}
    every, few = call(False), call(True)
    assert len(want) > 50 and want <= every and few <= every and {x for p in every for x in p} == {x for p in few for x in p}
