import corpus_pipeline
from tests.llm import brute
from tests.llm.test_joins import expected_lines, line_docs
from tests.llm.test_text_operators import sorted_rows

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "extra"]


def test_each_stage_on_its_own_input(spark, tables):
    docs = spark.createDataFrame(brute.rows([*brute.ODD, *line_docs()]), brute.DOCS).unionByName(spark.read.parquet(f"{tables}/documents.parquet"), allowMissingColumns=True)
    docs = docs.filter("doc_id is not null").cache()
    bench = [(r[0], r[1]) for r in spark.read.parquet(f"{tables}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        had = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = stage(spark, docs, tables).cache()
        got = out.collect()
        if name == "language ID":
            assert {r["doc_id"] for r in got} == {d for d, t in had if t and any(c.isalpha() for c in t)}
        elif name == "line dedup":
            want = {d: (k, s) for d, _, k, s in expected_lines(had)}
            left = {r["doc_id"]: r["text"] for r in got}
            assert all(brute.sha(left[d]) == s for d, (k, s) in want.items() if d in left)
            assert all(k and s == brute.sha("") or k for d, (k, s) in want.items() if d not in left)
            assert all(r["n_chars"] == len(r["text"]) for r in got)
        elif name == "n-gram Jaccard join":
            assert {r["doc_id"] for r in got} == {d for d, _, c in brute.jaccard_components(had, 5, 80) if d == c}
        elif name == "benchmark decontamination":
            assert {r["doc_id"] for r in got} == {r[0] for r in brute.decontaminated(had, bench) if not r[5]}
        else:
            assert {(r["doc_id"], r["decoded_sha256"]) for r in got} == {(d, brute.sha(t)) for d, t in had}
            assert all(len(r["ids"]) == r["n_tokens"] for r in got)
            break
        assert out.columns == COLUMNS[:-1] + ["extra"]
        docs = out


def test_run_equals_its_stages(spark, tables):
    df = corpus_pipeline.run(spark, tables)
    assert df.count() > 50 and df.filter("n_tokens = 0").count() == 0
    assert sorted_rows(df.select("doc_id")) == sorted_rows(df.select("doc_id").distinct())


def test_stages_take_nulls_and_empty_tables(spark, tables):
    docs = spark.createDataFrame([(None, None, None, None, None, "x"), (None, "some words of English text stand here", "en", "s", 1, "y"), (7, None, None, "s", None, "z")], brute.DOCS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), tables).count() == 0
        rows = stage(spark, docs, tables).collect()
        assert len(rows) == (0 if name == "language ID" else 3)


def test_one_document_of_each_group_stays_whatever_its_id(spark, tables):
    near = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"]
    text = " ".join(f"word{i} of a long line" for i in range(30))
    docs = [(5, text, "a"), (5, text, "a"), (6, text + " end", "b"), (None, text, "c"), (None, "quite another text without any copy at all", "d"), (7, "one more text of seven words here", "e"), (7, "and this one has the same id", "f"), (8, "", "g"), (8, "", "g"), (9, None, "h")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, source string, _node string")
    out = near(spark, df, tables)
    assert out.columns == df.columns
    got = sorted(((r["doc_id"], r["source"]) for r in out.collect()), key=str)
    assert len([1 for _, s in got if s in "abc"]) == 1 and (6, "b") in got
    assert [x for x in got if x[1] not in "abc"] == [(7, "e"), (7, "f"), (8, "g"), (8, "g"), (9, "h"), (None, "d")]
    same = near(spark, spark.createDataFrame([(3, text), (3, text), (3, text)], "doc_id bigint, text string"), tables).collect()
    assert [r["doc_id"] for r in same] == [3]
