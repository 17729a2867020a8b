from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathom.functions import fuzzy, vectors
from fathom.functions import text as tx
from fathom.operators import segmentation as sg


def one(spark, value, expr, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("x")).alias("y")).first().y


def test_tokens_keep_joined_words_and_split_cjk(spark):
    assert one(spark, "Use C++ x-y foo.bar 知识库!", tx.tokens) == ["use", "c", "x-y", "foo.bar", "知", "识", "库", "知识", "识库"]
    assert one(spark, None, tx.tokens) == []
    assert one(spark, "ＡＢ", lambda c: tx.tokens(tx.nfkc(c))) == ["ab"]


def test_section_titles(spark):
    for line, title in [("# One #", "One"), ("   ## Two", "Two"), ("第三章 开始", "第三章 开始"), ("1.2.3. Goals", "1.2.3. Goals"), ("3.14 value", "3.14 value"), ("plain", None), ("1." + "x" * 161, None)]:
        assert one(spark, line, tx.section_title) == title, line


def test_markdown_segments_and_sections(spark):
    text = "before\n# A\nbody\n\n## B ##\n\n    # indented\n# C"
    rows = sg.markdown_segments(spark.createDataFrame([(1, text)], "id int, text string"), ["id"]).orderBy("location_index").collect()
    assert [(r.location_index, r.section) for r in rows] == [(1, tx.BODY), (2, "A"), (3, "B"), (4, "C")]
    assert rows[2].text.endswith("# indented")


def test_chunk_lengths(spark):
    want = {0: 0, 1: 1, 449: 1, 450: 1, 451: 2, 500: 2, 501: 2, 950: 3}
    rows = spark.createDataFrame([(n, 1, tx.BODY, "x" * n) for n in want], "id int, run int, section string, text string")
    found = {r.id: r["count"] for r in sg.chunks(rows, ["id"], ["run"]).groupBy("id").count().collect()}
    assert {n: found.get(n, 0) for n in want} == want


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("ab \n#1.")), min_size=1, max_size=5))
def test_chunks_cover_every_character_but_blanks(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    made = sg.chunks(sg.sections(rows, ["id"]), ["id"], ["run"]).orderBy("id", "chunk_index").collect()
    for i, text in enumerate(texts):
        own = [r for r in made if r.id == i]
        assert [r.chunk_index for r in own] == list(range(len(own)))
        assert "".join("".join(r.text for r in own).split()) == "".join(text.split())


def test_table_and_fence_and_windows(spark):
    assert one(spark, [["a ", "b"], ["", ""], ["c"]], tx.table_markdown, "x array<array<string>>") == "| a | b |\n| --- | --- |\n| c |  |"
    assert one(spark, "```python\nx = 1\n```", tx.strip_code_fence) == "x = 1"
    assert [len(w) for w in one(spark, "y" * 1000, tx.rerank_windows)] == [360, 360, 360]
    assert one(spark, "short", tx.rerank_windows) == ["short"]


def test_coverage_and_jaccard(spark):
    q, d = "a query term", "the term of a query"
    assert one(spark, q, lambda c: tx.coverage(tx.tokens(c), tx.tokens(F.lit(d)))) == 1.0
    assert one(spark, "", lambda c: tx.coverage(tx.tokens(c), tx.tokens(F.lit(d)))) == 0.0
    assert one(spark, "", lambda c: tx.jaccard(tx.tokens(c), tx.tokens(F.lit("")))) == 0.0


def test_vectors(spark):
    arr = "x array<float>"
    same = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, [3.0, 4.0], lambda c: vectors.cosine(c, same), arr) == 1.0
    assert one(spark, [-3.0, -4.0], lambda c: vectors.cosine(c, same), arr) == -1.0
    assert one(spark, [0.0, 0.0], lambda c: vectors.cosine(c, same), arr) == 0.0
    assert one(spark, None, lambda c: vectors.cosine(c, same), arr) == 0.0
    assert one(spark, None, vectors.relevance, "x double") == 0.0
    assert one(spark, 5.0, vectors.relevance, "x double") == 0.0


def test_fuzzy_scores(spark):
    score = lambda q, n: fuzzy.scored(spark.createDataFrame([(n,)], "name string"), F.lit(q)).first().score
    assert score("Report", "report.pdf") == 1.0
    assert 0.9 < score("repo", "report.pdf") < 1.0
    assert score("z", "report") == 0.0
    assert 0.6 < score("reprot", "report.md") < 0.9
    assert score("", "report") == 0.0


def test_rows_of_one_id_keep_their_own_sections(spark):
    rows = spark.createDataFrame([(1, "a b\nc d"), (1, "x\n# T\nz")], "id int, text string")
    assert sorted(r.text for r in sg.sections(rows, ["id"]).collect()) == ["# T\nz", "a b\nc d", "x"]
    assert "Exchange" not in sg.document_chunks(rows, ["id"])._jdf.queryExecution().executedPlan().toString()


def test_compatible_forms_and_folding(spark):
    assert one(spark, "ＡＢＣ ﬁle", tx.tokens) == ["abc", "file"]
    assert one(spark, "Straße.TXT", fuzzy.normalized) == "strassetxt"
    assert one(spark, "  short ", tx.rerank_windows) == ["short"] and one(spark, None, tx.rerank_windows) == [""]


def test_runs_of_lines_are_linear_and_no_filter_is_inferred(spark, tmp_path):
    text = "\n".join(f"# head {i}" if i % 20 == 0 else f"line {i} of the text" for i in range(20_000))
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "long"))
    docs = spark.read.parquet(str(tmp_path / "long"))
    for found in (sg.sections(docs, ["doc_id"]), sg.markdown_segments(docs, ["doc_id"]), sg.document_chunks(docs, ["doc_id"])):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if "Filter" in line and "split" in line]
        assert found.count() >= 1000
    assert sg.sections(docs, ["doc_id"]).agg({"run": "max"}).first()[0] == 1000
