"""Retrieval queries. The corpus pairs documents with embeddings of the same number; queries are the benchmark items
(or vectors) whose number is divisible by 100, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import text as tx
from fathom.functions.vectors import relevance
from fathom.operators import pruned
from fathom.operators import retrieval as rt
from fathom.session import cut, table

EVERY = 100


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    items = table(spark, sf_dir, "benchmark").where(F.col("item_id") % EVERY == 0).select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return items.join(vectors, "query_id")


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang").join(vectors, "doc_id")


def _candidates(spark: SparkSession, sf_dir: str, keep: F.Column | None = None) -> DataFrame:
    corpus, queries = _corpus(spark, sf_dir), _queries(spark, sf_dir)
    if keep is not None:
        corpus = corpus.where(keep)
    top = cut(rt.vector_topk(corpus.select("doc_id", "embedding"), queries), "top")
    rows = top.join(corpus, "doc_id").join(queries.select("query_id", "query_text"), "query_id")
    return rows.withColumns({"tokens": tx.tokens(F.col("text")), "query_tokens": tx.tokens(F.col("query_text"))})


def _hybrid(spark: SparkSession, sf_dir: str, keep: F.Column | None = None) -> DataFrame:
    return rt.with_hybrid(rt.with_bm25(_candidates(spark, sf_dir, keep)))


def _picked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    scored = cut(_hybrid(spark, sf_dir), "hybrid")
    return scored, scored.join(rt.mmr(scored), ["query_id", "doc_id"])


def _r(name: str) -> F.Column:
    return F.round(name, 6).alias(name)


def retrieval_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    queries = rows.where(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    top = rt.vector_topk(rows, queries)
    return top.select("query_id", "doc_id", "vector_rank", F.round(relevance(F.col("distance")), 6).alias("relevance"))


def retrieval_pruned_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows, by an index of clusters and pieces that bounds tell to read or to skip."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    queries = rows.where(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    top = pruned.topk(rows, queries)
    return top.select("query_id", "doc_id", "vector_rank", F.round(relevance(F.col("distance")), 6).alias("relevance"))


def retrieval_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.with_bm25(_candidates(spark, sf_dir)).select("query_id", "doc_id", _r("bm25"))


def retrieval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tx.coverage(F.col("query_tokens"), F.col("tokens"))
    return _candidates(spark, sf_dir).select("query_id", "doc_id", F.round(found, 6).alias("coverage"))


def retrieval_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir).select("query_id", "doc_id", "hybrid_rank", _r("hybrid"))


def retrieval_scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = rt.scope_filter(F.col("source"), F.col("doc_id"), courses=["src1", "src3", "src1"])
    return _hybrid(spark, sf_dir, keep).select("query_id", "doc_id", "hybrid_rank", _r("hybrid"))


def retrieval_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, picked = _picked(spark, sf_dir)
    return picked.select("query_id", "doc_id", "mmr_rank", _r("mmr_score"))


def retrieval_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, picked = _picked(spark, sf_dir)
    return rt.final(picked, ["source", "lang"], min_relevance=0.2).select("query_id", "doc_id", "final_rank", _r("final"))


def retrieval_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, picked = _picked(spark, sf_dir)
    return rt.diagnostics(scored, picked, rt.final(picked, ["source", "lang"], min_relevance=0.2))


def retrieval_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, picked = _picked(spark, sf_dir)
    chosen = rt.final(picked, ["source", "lang"], min_relevance=0.2)
    named = chosen.withColumns({"file": F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), "place": F.col("source"), "body": F.col("text")})
    made = rt.context(named, _queries(spark, sf_dir))
    return made.select("query_id", "insufficient", F.md5(F.col("context").cast("binary")).alias("context_md5"))


def lexical_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item against the next one."""
    items = table(spark, sf_dir, "benchmark").select("item_id", tx.tokens(F.col("text")).alias("own"))
    after = items.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("next_id"), F.col("own").alias("other"))
    return items.join(after, "item_id").select("item_id", "next_id", F.round(tx.jaccard(F.col("own"), F.col("other")), 6).alias("similarity"))


def rerank_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.rerank_windows(F.col("text"))).alias("n", "passage"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n"), F.md5(F.col("passage").cast("binary")).alias("passage_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        retrieval_vector_topk,
        retrieval_pruned_topk,
        retrieval_bm25,
        retrieval_coverage,
        retrieval_hybrid,
        retrieval_scope_filter,
        retrieval_mmr,
        retrieval_final,
        retrieval_diagnostics,
        retrieval_context,
        lexical_jaccard,
        rerank_windows,
    )
}

_TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+(?:[._+/-][a-z0-9]+)*|[\\x{{3400}}-\\x{{9fff}}]+')"
_RANKED = """
    q AS (
        SELECT b.item_id AS query_id, b.text AS query_text, e.embedding::DOUBLE[] AS qv
        FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id WHERE b.item_id % 100 = 0
    ), corpus AS (
        SELECT d.doc_id, d.text, d.source, d.lang, e.embedding::DOUBLE[] AS v
        FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id {where}
    ), dist AS (
        SELECT query_id, query_text, doc_id, text, source, lang, v,
            list_inner_product(qv, qv) + list_inner_product(v, v) - 2 * list_inner_product(qv, v) AS distance FROM q, corpus
    ), top AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), doc_id) AS vector_rank
        FROM dist QUALIFY vector_rank <= 10
    ), cand AS (
        SELECT *, {tokens} AS tokens, {query_tokens} AS query_tokens FROM top
    ), sized AS (
        SELECT *, count(*) OVER (PARTITION BY query_id) AS n_docs, avg(len(tokens)) OVER (PARTITION BY query_id) AS mean_length FROM cand
    ), terms AS (
        SELECT query_id, doc_id, n_docs, mean_length, greatest(len(tokens), 1) AS length, tokens, unnest(list_distinct(query_tokens)) AS token FROM sized
    ), tf AS (
        SELECT *, len(list_filter(tokens, lambda t: t = token)) AS tf FROM terms
    ), hits AS (
        SELECT *, count(*) OVER (PARTITION BY query_id, token) AS df FROM tf WHERE tf > 0
    ), raw AS (
        SELECT query_id, doc_id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))) AS raw
        FROM hits GROUP BY ALL
    ), lexical AS (
        SELECT c.*, coalesce(coalesce(r.raw, 0) / max(r.raw) OVER (PARTITION BY c.query_id), 0) AS bm25,
            list_distinct(CASE WHEN len(list_filter(query_tokens, lambda t: length(t) > 1)) > 0
                THEN list_filter(query_tokens, lambda t: length(t) > 1) ELSE query_tokens END) AS wanted
        FROM cand c LEFT JOIN raw r USING (query_id, doc_id)
    ), covered AS (
        SELECT *, CASE WHEN len(wanted) = 0 THEN 0.0 ELSE len(list_intersect(wanted, tokens)) / len(wanted) END AS coverage,
            greatest(0, least(1, 1 - distance / 2)) AS relevance FROM lexical
    ), scored AS (
        SELECT *, 0.68 * relevance + 0.22 * bm25 + 0.10 * coverage AS hybrid FROM covered
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(hybrid, 9) DESC, vector_rank) AS hybrid_rank FROM scored
    )
"""


def _sql(select: str, where: str = "") -> str:
    return "WITH RECURSIVE " + _RANKED.format(where=where, tokens=_TOKENS.format("text"), query_tokens=_TOKENS.format("query_text")) + select


# The greedy picks as a recursion over (picked, left) lists of row numbers.
_PICKS = """
    , sims AS (
        SELECT a.query_id, a.hybrid_rank AS i, b.hybrid_rank AS j,
            greatest(0, least(1, list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))))) AS sim
        FROM ranked a JOIN ranked b USING (query_id)
    ), steps AS (
        SELECT query_id, 0 AS step, []::BIGINT[] AS chosen, 0.0::DOUBLE AS score FROM (SELECT DISTINCT query_id FROM ranked)
        UNION ALL
        (SELECT s.query_id, s.step + 1, list_append(s.chosen, r.hybrid_rank),
            0.72 * r.hybrid - 0.28 * coalesce((SELECT max(sim) FROM sims x WHERE x.query_id = s.query_id AND x.i = r.hybrid_rank AND list_contains(s.chosen, x.j)), 0) AS mmr
        FROM steps s JOIN ranked r ON r.query_id = s.query_id AND NOT list_contains(s.chosen, r.hybrid_rank)
        WHERE s.step < 8
        QUALIFY row_number() OVER (PARTITION BY s.query_id ORDER BY mmr DESC, r.hybrid_rank) = 1)
    ), picked AS (
        SELECT r.*, s.step AS mmr_rank, s.score AS mmr_score FROM steps s JOIN ranked r ON r.query_id = s.query_id AND r.hybrid_rank = s.chosen[-1] WHERE s.step > 0
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY query_id, source, lang ORDER BY round(hybrid, 9) DESC, hybrid_rank) AS at_place FROM picked WHERE hybrid >= 0.2
    ), chosen AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(hybrid, 9) DESC, hybrid_rank) AS final_rank FROM placed
        WHERE at_place = 1 QUALIFY final_rank <= 3
    )
"""

_NEAREST = """
    WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), dist AS (
        SELECT q.vec_id AS query_id, c.vec_id AS doc_id,
            list_inner_product(q.v, q.v) + list_inner_product(c.v, c.v) - 2 * list_inner_product(q.v, c.v) AS distance
        FROM v q, v c WHERE q.vec_id % 100 = 0
    )
    SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), doc_id) AS vector_rank,
        round(greatest(0, least(1, 1 - distance / 2)), 6) AS relevance
    FROM dist QUALIFY vector_rank <= 10
"""

ORACLE_SQL = {
    "retrieval_vector_topk": _NEAREST,
    "retrieval_pruned_topk": _NEAREST,
    "retrieval_bm25": _sql("SELECT query_id, doc_id, round(bm25, 6) AS bm25 FROM ranked"),
    "retrieval_coverage": _sql("SELECT query_id, doc_id, round(coverage, 6) AS coverage FROM ranked"),
    "retrieval_hybrid": _sql("SELECT query_id, doc_id, hybrid_rank, round(hybrid, 6) AS hybrid FROM ranked"),
    "retrieval_scope_filter": _sql("SELECT query_id, doc_id, hybrid_rank, round(hybrid, 6) AS hybrid FROM ranked", "WHERE d.source IN ('src1', 'src3')"),
    "retrieval_mmr": _sql(_PICKS + "SELECT query_id, doc_id, mmr_rank::BIGINT AS mmr_rank, round(mmr_score, 6) AS mmr_score FROM picked"),
    "retrieval_final": _sql(_PICKS + "SELECT query_id, doc_id, final_rank, round(hybrid, 6) AS final FROM chosen"),
    "retrieval_diagnostics": _sql(
        _PICKS
        + """SELECT r.query_id, count(*) AS n_candidates, (SELECT count(*) FROM picked p WHERE p.query_id = r.query_id) AS n_pool,
            (SELECT count(*) FROM chosen c WHERE c.query_id = r.query_id) AS n_selected, round(max(hybrid), 6) AS best_score
        FROM ranked r GROUP BY r.query_id"""
    ),
    "retrieval_context": _sql(
        _PICKS
        + """SELECT q.query_id, count(c.doc_id) = 0 AS insufficient,
            md5(coalesce(string_agg('【来源' || final_rank || '｜doc-' || doc_id || '｜' || source || '】' || chr(10) || text,
                chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY final_rank), '')) AS context_md5
        FROM q LEFT JOIN chosen c ON c.query_id = q.query_id GROUP BY q.query_id"""
    ),
    "lexical_jaccard": f"""
        WITH t AS (SELECT item_id, list_distinct({_TOKENS.format('text')}) AS own FROM benchmark)
        SELECT a.item_id, b.item_id AS next_id,
            round(CASE WHEN len(a.own) + len(b.own) = 0 THEN 0.0
                ELSE len(list_intersect(a.own, b.own)) / len(list_distinct(list_concat(a.own, b.own))) END, 6) AS similarity
        FROM t a JOIN t b ON b.item_id = a.item_id + 1
    """,
    "rerank_windows": """
        WITH w AS (
            SELECT doc_id, text, CASE WHEN length(text) <= 360 THEN [0]
                ELSE list_sort(list_distinct([0, greatest(0, length(text) // 2 - 180), greatest(0, length(text) - 360)])) END AS starts
            FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS text FROM documents)
        ), e AS (SELECT doc_id, text, unnest(starts) AS s, generate_subscripts(starts, 1) - 1 AS n FROM w)
        SELECT doc_id, n::BIGINT AS n, md5(CASE WHEN length(text) <= 360 THEN text ELSE substring(text, s + 1, 360) END) AS passage_md5 FROM e
    """,
}
