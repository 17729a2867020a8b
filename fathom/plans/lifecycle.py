"""Queries over the life of files: headings and pages of what engines leave, vectors that move with their files, health,
rerank fusion, folder scopes, retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators import catalog as ct
from fathom.operators import retrieval as rt
from fathom.operators import rules
from fathom.operators import segmentation as sg
from fathom.operators import tasks as tk
from fathom.session import table
from fathom.sources import layout


def _md5(c: str) -> F.Column:
    return F.md5(F.col(c).cast("binary")).alias(f"{c}_md5")


def _headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under headings: text before the first one, a closed heading, a nested one and an indented line."""
    pieces = [F.substring("text", 1, 40), F.lit("\n# "), F.col("source"), F.lit(" #\n"), F.col("text"), F.lit("\n### "), F.col("lang"), F.lit("\n    # no heading\n1.2. Part "), F.col("lang"), F.lit("\n"), F.substring("text", 1, 700)]
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(*pieces).alias("text"))


def markdown_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sg.markdown_segments(_headed(spark, sf_dir), ["doc_id"])
    return found.select("doc_id", "location_index", "section", _md5("text"))


def markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the sections, title lines and numbered ones included."""
    found = sg.document_chunks(_headed(spark, sf_dir), ["doc_id"])
    return found.select("doc_id", "run", "section", "chunk_index", _md5("text"))


def markdown_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.unit_count(sg.markdown_segments(_headed(spark, sf_dir), ["doc_id"]), ["doc_id"])


def paged_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document has no page marks and is page 0."""
    marked = F.concat(F.lit("{0}------\n"), F.col("text"), F.lit("\n{4}------\n"), F.col("source"), F.lit("\n{5}------\n  \n"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(marked).alias("text"))
    return layout.paged_markdown(docs, ["doc_id"]).select("doc_id", "page", _md5("text"))


def content_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with captions, lists, blocks without a page, and wrapped lists."""
    blocks = F.to_json(
        F.array(
            F.struct(F.lit(0).alias("page_idx"), F.col("source").alias("table_body"), F.lit("a \"caption\"").alias("table_caption"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("array<string>").alias("list_items")),
            F.struct(F.lit(0).alias("page_idx"), F.lit(None).cast("string").alias("table_body"), F.lit(None).cast("string").alias("table_caption"), F.col("lang").alias("text"), F.array(F.lit("one"), F.lit("two")).alias("list_items")),
            F.struct(F.lit(None).cast("int").alias("page_idx"), F.lit(None).cast("string").alias("table_body"), F.lit(None).cast("string").alias("table_caption"), F.lit("lost").alias("text"), F.lit(None).cast("array<string>").alias("list_items")),
        )
    )
    payload = F.when(F.col("doc_id") % 2 == 0, blocks).otherwise(F.concat(F.lit('{"content_list":'), blocks, F.lit("}")))
    return layout.content_list(table(spark, sf_dir, "documents").select("doc_id", payload.alias("payload")), ["doc_id"]).select("doc_id", "page", "text")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("file_id"), F.lit(0).cast("long").alias("chunk"), F.col("label").cast("long").alias("folder_id"))


def vector_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of every tenth vector were read again: two chunks each, none for every thirtieth."""
    owners = _vectors(spark, sf_dir).where("file_id % 10 = 0")
    new = owners.where("file_id % 30 <> 0").select("file_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("chunk"), "folder_id")
    return ct.replaced(_vectors(spark, sf_dir), new, "file_id", owners)


def vector_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors follow labelled files to the folder of their quality; an unknown folder moves nothing."""
    moves = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file_id"), (F.col("quality") + 100).cast("long").alias("to")).where("to is not null").groupBy("file_id").agg(F.min("to").alias("to"))
    return ct.moved(_vectors(spark, sf_dir), moves, "file_id", "folder_id")


def vector_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("file_id")).distinct()
    return ct.without(_vectors(spark, sf_dir), gone, "file_id").select("file_id", "chunk")


def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, bytes, missing files and the healthy flag, where sources of every seventh document are gone."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("ready").alias("status"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.octet_length("text").cast("long").alias("size"))
    listed = docs.where("id % 7 <> 0").select("path", "size")
    return ct.overview(docs, listed, _vectors(spark, sf_dir))


def missing_source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    return ct.missing_files(docs, docs.where("id % 7 <> 0").select("path"))


def rerank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of two passages a candidate, some outside 0 to 1: the best passage counts, fused with the other parts."""
    rows = table(spark, sf_dir, "labels").where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = rows.select((F.col("doc_id") % 100).alias("query_id"), "doc_id", "quality", "toxic")
    passages = rows.select("query_id", "doc_id", F.explode(F.array(F.col("quality") * 0.4 - 0.5, F.col("doc_id") % 7 / 4.0)).alias("score"))
    joined = rows.join(rt.best_windows(passages), ["query_id", "doc_id"])
    scored = joined.withColumns({"relevance": F.col("quality") * 0.5, "bm25": F.col("doc_id") % 3 / 4.0, "coverage": F.col("doc_id") % 5 / 8.0, "hybrid": F.lit(0.0), "hybrid_rank": F.col("doc_id")})
    return rt.final(scored, ["doc_id"], min_relevance=0.3, rerank=F.col("rerank")).select("query_id", "doc_id", "final_rank", F.round("final", 6).alias("final"))


def folder_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, as files, of nations that lie in the first two regions, as folders."""
    region = table(spark, sf_dir, "region").selectExpr("cast(r_regionkey + 1 as long) id", "cast(null as long) parent_id", "r_name name")
    nation = table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey + 100 as long) id", "cast(n_regionkey + 1 as long) parent_id", "n_name name")
    files = table(spark, sf_dir, "customer").selectExpr("c_custkey file_id", "cast(c_nationkey + 100 as long) folder_id")
    return rt.within_folders(files, "folder_id", region.where("id <= 2"), region.union(nation))


def answers_in_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("noise <answer> B. "), F.col("source"), F.lit(" </answer> <answer>x</answer>"))
    return table(spark, sf_dir, "documents").select("doc_id", rules.tagged_answer(text).alias("answer"))


def retried_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed tasks that may be run again, as queued ones under new ids."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), "ts", F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"))
    latest = tk.current(events).withColumn("retryable", F.col("task_id") % 3 != 0)
    return tk.retried(latest).select("task_id", "retry_of", "status")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines from chunks of a stream that break anywhere: each event writes half a line and the other half later."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.concat("event_type", F.lit("\r\n"), F.col("event_type")).alias("chunk"))
    return tk.framed(events).groupBy("task_id").agg(F.count(F.lit(1)).alias("n_lines"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "|").cast("binary")).alias("lines_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        markdown_headings, markdown_chunks, markdown_units, paged_texts, content_blocks, vector_replace, vector_move, vector_delete, dashboard,
        missing_source_files, rerank_fusion, folder_scope, answers_in_tags, retried_tasks, log_lines,
    )
}

_HEADED = r"""
    headed AS (
        SELECT doc_id, left(text, 40) || chr(10) || '# ' || source || ' #' || chr(10) || text || chr(10) || '### ' || lang || chr(10) || '    # no heading'
            || chr(10) || '1.2. Part ' || lang || chr(10) || left(text, 700) AS text FROM documents
    ), parts AS (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS p FROM headed
    ), lines AS (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS n FROM parts
    ), clean AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS c FROM lines)
"""
_RUNS = r"""
    , runs AS (SELECT *, sum((title IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM titled
    ), joined AS (
        SELECT doc_id, run, left(coalesce(max(title), '正文'), 180) AS section, regexp_replace(string_agg(line, chr(10) ORDER BY n), '^\s+|\s+$', '', 'g') AS text
        FROM runs GROUP BY doc_id, run
    ), segments AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY run) AS location_index FROM joined WHERE text <> '')
"""
_MARKDOWN = f"WITH {_HEADED}" + r""", titled AS (
        SELECT *, CASE WHEN regexp_matches(line, '^\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$') THEN trim(regexp_extract(line, '^\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$', 1)) END AS title FROM clean
    )""" + _RUNS

ORACLE_SQL = {
    "markdown_headings": _MARKDOWN + "SELECT doc_id, location_index, section, md5(text) AS text_md5 FROM segments",
    "markdown_units": _MARKDOWN + "SELECT doc_id, max(location_index) AS unit_count FROM segments GROUP BY doc_id",
    "markdown_chunks": f"WITH {_HEADED}" + r""", titled AS (
            SELECT *, CASE WHEN regexp_matches(c, '^\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$') THEN trim(regexp_extract(c, '^\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$', 1))
                WHEN regexp_matches(c, '^\s*(?:[0-9]+(?:\.[0-9]+){0,3})[.]\s*(.{1,160})$') THEN c END AS title FROM clean
        )""" + _RUNS + r""", starts AS (SELECT doc_id, run, section, text, unnest(generate_series(0, length(text) - 1, 450)) AS s FROM segments
        ), cutup AS (SELECT doc_id, run, section, s, regexp_replace(substring(text, s + 1, 500), '^\s+|\s+$', '', 'g') AS text FROM starts)
        SELECT doc_id, run::BIGINT AS run, section, row_number() OVER (PARTITION BY doc_id ORDER BY run, s) - 1 AS chunk_index, md5(text) AS text_md5 FROM cutup WHERE text <> ''""",
    "paged_texts": r"""WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, source FROM documents), p AS (
            SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS page, text FROM t UNION ALL SELECT doc_id, 5, source FROM t WHERE doc_id % 3 <> 0
        ) SELECT doc_id, page::BIGINT AS page, md5(text) AS text_md5 FROM p WHERE text <> ''""",
    "content_blocks": """SELECT doc_id, 1::BIGINT AS page, source || chr(10) || 'a "caption"' || chr(10) || lang || chr(10) || 'one' || chr(10) || 'two' AS text FROM documents""",
    "vector_replace": """WITH v AS (SELECT vec_id AS file_id, label::BIGINT AS folder_id FROM embeddings)
        SELECT file_id, 0::BIGINT AS chunk, folder_id FROM v WHERE file_id % 10 <> 0 OR file_id % 30 <> 0
        UNION ALL SELECT file_id, 1, folder_id FROM v WHERE file_id % 10 = 0 AND file_id % 30 <> 0""",
    "vector_move": """SELECT vec_id AS file_id, 0::BIGINT AS chunk, coalesce(m.to_folder, label)::BIGINT AS folder_id
        FROM embeddings LEFT JOIN (SELECT doc_id, min(quality) + 100 AS to_folder FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) m ON m.doc_id = vec_id""",
    "vector_delete": "SELECT vec_id AS file_id, 0::BIGINT AS chunk FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)",
    "dashboard": """SELECT count(*) AS n_files, count(*) AS n_ready, coalesce(sum(strlen(text)) FILTER (doc_id % 7 <> 0), 0)::BIGINT AS bytes,
        count(*) FILTER (doc_id % 7 = 0) AS n_missing_files, count(*) FILTER (doc_id NOT IN (SELECT vec_id FROM embeddings)) AS n_missing_vectors,
        (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS n_orphan_vectors,
        count(*) FILTER (doc_id % 7 = 0) = 0 AND count(*) FILTER (doc_id NOT IN (SELECT vec_id FROM embeddings)) = 0 AS healthy FROM documents""",
    "missing_source_files": "SELECT 'missing_files' AS code, 'error' AS level, doc_id AS file_id FROM documents WHERE doc_id % 7 = 0",
    "rerank_fusion": """WITH r AS (SELECT doc_id % 100 AS query_id, doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
        ), b AS (SELECT *, greatest(quality * 0.4::DOUBLE - 0.5::DOUBLE, doc_id % 7 / 4.0::DOUBLE) AS best FROM r
        ), f AS (SELECT query_id, doc_id, 0.70::DOUBLE * CASE WHEN best < 0 OR best > 1 THEN 1 / (1 + exp(-best)) ELSE best END + 0.18::DOUBLE * quality * 0.5::DOUBLE
            + 0.08::DOUBLE * (doc_id % 3) / 4.0::DOUBLE + 0.04::DOUBLE * (doc_id % 5) / 8.0::DOUBLE AS final FROM b)
        SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(final, 9) DESC, doc_id) AS final_rank, round(final, 6) AS final FROM f WHERE final >= 0.3 QUALIFY final_rank <= 3""",
    "folder_scope": "SELECT c_custkey AS file_id, c_nationkey::BIGINT + 100 AS folder_id FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <= 1",
    "answers_in_tags": "SELECT doc_id, source AS answer FROM documents",
    "retried_tasks": """SELECT 'retry-' || user_id AS task_id, user_id AS retry_of, 'queued' AS status
        FROM (SELECT user_id, arg_max(event_type, event_id) AS last FROM events GROUP BY user_id) WHERE last = 'error' AND user_id % 3 <> 0""",
    "log_lines": """WITH j AS (SELECT user_id AS task_id, string_agg(event_type || chr(10) || event_type, '' ORDER BY event_id) AS log FROM events GROUP BY user_id)
        SELECT task_id, len(string_split(log, chr(10))) AS n_lines, md5(array_to_string(string_split(log, chr(10)), '|')) AS lines_md5 FROM j""",
}
