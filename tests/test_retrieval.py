import math

from pyspark.sql import functions as F

from fathom.functions import text as tx
from fathom.operators import retrieval as rt


def test_topk_is_exact_over_blocks(spark):
    rows = spark.range(200).select(F.col("id").alias("doc_id"), F.array(F.cos("id"), F.sin("id")).cast("array<float>").alias("embedding"))
    queries = rows.where("doc_id < 5").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    one, many = (rt.vector_topk(rows.repartition(7), queries, 4, block).select("query_id", "doc_id", "vector_rank") for block in (100, 2))
    got = sorted(map(tuple, one.collect()))
    assert got == sorted(map(tuple, many.collect())) and len(got) == 20
    assert all(d == q for q, d, r in got if r == 1)
    for q in range(5):
        near = sorted(range(200), key=lambda d: -math.cos(d - q))[:4]
        assert {d for x, d, _ in got if x == q} == set(near)


def candidates(spark, query, docs):
    rows = [(0, i, i + 1, 0.1 * i, t, query) for i, t in enumerate(docs)]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, vector_rank long, distance double, text string, query_text string")
    return df.withColumns({"tokens": tx.tokens(F.col("text")), "query_tokens": tx.tokens(F.col("query_text")), "embedding": F.array(F.lit(1.0), F.lit(0.0))})


def bm25(query, docs):
    toks = [t.split() for t in docs]
    mean = sum(map(len, toks)) / len(toks) or 1.0
    raw = []
    for t in toks:
        s = 0.0
        for w in set(query.split()):
            tf, df = t.count(w), sum(w in x for x in toks)
            if tf:
                s += math.log(1 + (len(toks) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * (len(t) or 1) / mean))
        raw.append(s)
    return [r / max(raw) if max(raw) > 0 else 0.0 for r in raw]


def test_bm25_by_hand(spark):
    for query, docs in [("a b b", ["a b c", "b b", "c", ""]), ("zz", ["a", "b"]), ("", ["a"]), ("a", ["a"])]:
        got = [r.bm25 for r in rt.with_bm25(candidates(spark, query, docs)).orderBy("doc_id").collect()]
        assert all(abs(x - y) < 1e-12 for x, y in zip(got, bm25(query, docs), strict=True)), (query, got)


def test_mmr_takes_the_best_first_and_avoids_copies(spark):
    rows = [(1, 0, 0.9, 1, [1.0, 0.0], ["a"]), (1, 1, 0.89, 2, [1.0, 0.0], ["a"]), (1, 2, 0.6, 3, [0.0, 1.0], ["b"]), (1, 3, 0.5, 4, None, ["a"])]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, hybrid double, hybrid_rank long, embedding array<float>, tokens array<string>")
    got = [r.doc_id for r in rt.mmr(df, pool=3).orderBy("mmr_rank").collect()]
    assert got[0] == 0 and got.index(2) == 1 and len(got) == 3


def test_final_dedupes_places_and_cuts(spark):
    rows = [(1, i, 0.9 - 0.1 * i, i + 1, "p" if i < 2 else f"q{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, hybrid double, hybrid_rank long, place string")
    got = [r.doc_id for r in rt.final(df, ["place"], 0.55, 5).orderBy("final_rank").collect()]
    assert got == [0, 2, 3]
    empty = rt.context(rt.final(df, ["place"], 2.0).withColumns({"file": F.lit("f"), "body": F.lit("b")}), df.select("query_id").distinct()).first()
    assert empty.insufficient and empty.context == ""


def test_scope(spark):
    df = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "c int, f int")
    kept = lambda **k: [r.c for r in df.where(rt.scope_filter(F.col("c"), F.col("f"), **k)).orderBy("c").collect()]
    assert kept() == [1, 2, 3] and kept(courses=[2, 2], course_id=1) == [2] and kept(course_id=1) == [1] and kept(courses=[1, 2], files=[20]) == [2]


def test_places_of_passages(spark):
    rows = [(3, None, None, "s"), (0, None, None, "s"), (0, None, None, "正文"), (4, "slide", 0, None), (None, "web_section", 2, ""), (5, "page", 7, "t"), (None, "page", None, "t"), (None, None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, page long, location_type string, location_index long, section string")
    assert [r.place for r in rt.located(df).orderBy("id").collect()] == ["第 3 页｜s", "章节：s", "位置未标注", "第 4 张幻灯片", "网页章节 2", "第 7 页｜t", "章节：t｜t", "位置未标注"]
