"""Document queries: sections, chunks, duplicates, validation, page names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions import text as tx
from fathom.operators import intake
from fathom.operators import segmentation as sg
from fathom.session import table
from fathom.sources import html


def _md5(c: str) -> F.Column:
    return F.md5(F.col(c).cast("binary")).alias(f"{c}_md5")


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.sections(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


def doc_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir).select("doc_id", "run", "section", _md5("text"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.document_chunks(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), ["doc_id", "source"])


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("doc_id", "chunk_index", F.length("text").cast("long").alias("n_chars"), _md5("text"))


def doc_chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    counted = _chunks(spark, sf_dir).groupBy(F.col("source").alias("of")).agg(F.count(F.lit(1)).alias("n"), F.max("chunk_index").alias("last"), F.sum(F.length("text")).alias("chars"))
    return docs.join(counted, F.col("source").eqNullSafe(F.col("of")), "left").select(
        "source", "n_docs", F.coalesce("n", F.lit(0)).alias("n_chunks"), F.coalesce("last", F.lit(-1)).alias("last_chunk"), F.coalesce("chars", F.lit(0)).alias("chunk_chars")
    )


def html_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.segments(table(spark, sf_dir, "pages"), ["page_id"], "html")
    return found.select("page_id", "location_index", "section", _md5("text"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploaded files: labelled ones are ready, the others in progress."""
    labelled = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("labelled", F.lit(True))
    docs = table(spark, sf_dir, "documents").join(labelled, "doc_id", "left")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
        F.when(F.col("labelled"), "ready").otherwise("uploaded").alias("status"),
        F.col("n_chars").alias("updated"),
        F.concat_ws("-", "source", "lang").alias("name"),
        F.octet_length("text").alias("size"),
    )


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intake.registered(_files(spark, sf_dir).select("id", "sha256", "status"), ["sha256"], ["id"])
    return found.select("id", "sha256", "outcome", "canonical_id", "copies")


def same_name_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.best_version(_files(spark, sf_dir).withColumn("name_key", F.lower("name")), "name_key").select("name", "version_rank", "id", "status")


def upload_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).withColumn("file", F.concat("name", F.lit("-"), F.substring("sha256", 1, 1), F.lit(".md")))
    before = F.row_number().over(Window.partitionBy("file").orderBy("id")) - 1
    return files.withColumn("taken", before).select("id", intake.upload_name(F.col("file"), F.col("sha256"), F.col("taken")).alias("stored_name"))


def preflight_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length("text") * 1000).cast("long").alias("size"), F.when(F.col("doc_id") % 2 == 0, "file.pdf").otherwise("file.md").alias("name")
    )
    return sized.withColumns(intake.estimates(F.col("size"), F.col("name"))).drop("name")


def url_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(intake.web_url_problem(url), F.lit("ok")).alias("problem"), intake.trusted(url, ["example.com", "example.org"]).alias("trusted"))


def snapshot_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("sha", F.sha2(F.col("html").cast("binary"), 256))
    return pages.select("page_id", intake.snapshot_filename(F.col("url"), F.col("sha"), F.lit(None).cast("string")).alias("file_name"))


def type_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.element_at(F.array(*map(F.lit, (".PDF", ".docx", ".pptx", ".md", ".htm", ".bin"))), (F.col("page_id") % 6 + 1).cast("int"))
    named = table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace("url", "/+$", ""), suffix).alias("name"))
    kind = intake.document_type(F.col("name"))
    return named.select("page_id", kind.alias("document_type"), intake.mime_type(kind).alias("mime_type"), intake.unit_type(kind).alias("unit_type"))


def file_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("page.html", "page.pdf", "page.docx", "page.exe", "page.md")))
    named = table(spark, sf_dir, "pages").select(
        "page_id", F.col("html").cast("binary").alias("content"), F.element_at(kinds, (F.col("page_id") % 5 + 1).cast("int")).alias("name"),
        F.when(F.col("page_id") % 3 == 0, "image/png").otherwise("").alias("declared"),
    )
    return named.select("page_id", F.coalesce(intake.reject_reason(F.col("name"), F.col("content"), F.col("declared")), F.lit("ok")).alias("outcome"))


def highlight_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.array_distinct(F.filter(tx.tokens(F.col("text")), lambda t: F.length(t) > 1))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(terms, " ").alias("terms"))


QUERIES = {
    f.__name__: f
    for f in (
        doc_sections, doc_chunks, doc_chunk_stats, html_segments, exact_duplicates, same_name_versions, upload_names, preflight_estimates,
        url_validation, snapshot_filename, type_backfill, file_validation, highlight_terms,
    )
}

_SECTIONS = r"""
    parts AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '\r\n|\r|\n') AS p FROM documents),
    lines AS (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS n FROM parts),
    clean AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS c FROM lines),
    titled AS (
        SELECT *, CASE
            WHEN regexp_matches(c, '^\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$') THEN trim(regexp_extract(c, '^\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$', 1))
            WHEN regexp_matches(c, '^\s*(?:第[一二三四五六七八九十百千万0-9]+[章节部分]|(?:[一二三四五六七八九十]+|[0-9]+(?:\.[0-9]+){0,3})[、．.])\s*(.{1,160})$') THEN c
            END AS title FROM clean
    ),
    runs AS (SELECT *, sum((title IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM titled),
    joined AS (
        SELECT doc_id, run, left(coalesce(max(title), '正文'), 180) AS section,
            regexp_replace(string_agg(line, chr(10) ORDER BY n), '^\s+|\s+$', '', 'g') AS text
        FROM runs GROUP BY doc_id, run
    ),
    sections AS (SELECT * FROM joined WHERE text <> '')
"""
_CHUNKS = (
    _SECTIONS
    + r""", starts AS (SELECT doc_id, run, text, unnest(generate_series(0, length(text) - 1, 450)) AS s FROM sections),
    cutup AS (SELECT doc_id, run, s, regexp_replace(substring(text, s + 1, 500), '^\s+|\s+$', '', 'g') AS text FROM starts),
    chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run, s) - 1 AS chunk_index, text FROM cutup WHERE text <> '')
"""
)
_FILES = """
    files AS (
        SELECT d.doc_id AS id, sha256(d.text) AS sha256, CASE WHEN l.doc_id IS NULL THEN 'uploaded' ELSE 'ready' END AS status,
            n_chars AS updated, source || '-' || lang AS name
        FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)
    )
"""
_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)', 1))"

ORACLE_SQL = {
    "doc_sections": f"WITH {_SECTIONS} SELECT doc_id, run::BIGINT AS run, section, md5(text) AS text_md5 FROM sections",
    "doc_chunks": f"WITH {_CHUNKS} SELECT doc_id, chunk_index, length(text) AS n_chars, md5(text) AS text_md5 FROM chunks",
    "doc_chunk_stats": f"""WITH {_CHUNKS}, counted AS (
            SELECT doc_id, count(*) AS n, max(chunk_index) AS last, sum(length(text)) AS chars FROM chunks GROUP BY doc_id
        )
        SELECT source, count(*) AS n_docs, coalesce(sum(n), 0)::BIGINT AS n_chunks, coalesce(max(last), -1) AS last_chunk,
            coalesce(sum(chars), 0)::BIGINT AS chunk_chars
        FROM documents LEFT JOIN counted USING (doc_id) GROUP BY source""",
    "exact_duplicates": f"""WITH {_FILES}, best AS (
            SELECT sha256, min(id) FILTER (status = 'ready') AS ready, min(id) FILTER (status = 'uploaded') AS busy, count(*) AS copies FROM files GROUP BY sha256
        )
        SELECT id, f.sha256, CASE WHEN ready <> id THEN 'reuse' WHEN ready IS NULL AND busy <> id THEN 'conflict' ELSE 'new' END AS outcome,
            coalesce(ready, busy, id) AS canonical_id, copies
        FROM files f JOIN best b ON f.sha256 = b.sha256""",
    "same_name_versions": f"""WITH {_FILES}
        SELECT name, row_number() OVER (PARTITION BY lower(name) ORDER BY updated DESC, id) AS version_rank, id, status
        FROM files QUALIFY version_rank <= 8""",
    "upload_names": f"""WITH {_FILES}, named AS (
            SELECT *, name || '-' || left(sha256, 1) AS stem, row_number() OVER (PARTITION BY name || '-' || left(sha256, 1) ORDER BY id) - 1 AS taken FROM files
        )
        SELECT id, CASE WHEN taken = 0 THEN stem || '.md' WHEN taken = 1 THEN stem || '_' || left(sha256, 8) || '.md'
            ELSE stem || '_' || left(sha256, 8) || '_' || taken || '.md' END AS stored_name FROM named""",
    "preflight_estimates": """
        WITH s AS (SELECT doc_id, strlen(text)::BIGINT * 1000 AS size, doc_id % 2 = 0 AS pdf FROM documents)
        SELECT doc_id, size, CASE WHEN pdf THEN greatest(1, round_even(size / (350 * 1024), 0))::BIGINT END AS pages,
            greatest(2, round_even(size / (1024 * 1024) * CASE WHEN pdf THEN 2.2::DOUBLE ELSE 0.7::DOUBLE END, 0))::BIGINT AS seconds,
            greatest(size, floor(size * 1.35::DOUBLE))::BIGINT AS disk_bytes FROM s
    """,
    "url_validation": f"""
        WITH h AS (SELECT page_id, url, {_HOST} AS host, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme FROM pages)
        SELECT page_id, CASE WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN host = '' THEN 'no host'
            WHEN regexp_matches(host, '^(?:localhost|.*\\.local|.*\\.internal|0\\..*|10\\..*|127\\..*|169\\.254\\..*|192\\.168\\..*|172\\.(?:1[6-9]|2[0-9]|3[01])\\..*)$') THEN 'private host'
            WHEN regexp_matches(url, '^[^/]*//[^/?#]*@') THEN 'credentials' ELSE 'ok' END AS problem,
            starts_with(lower(url), 'https://') AND (host IN ('example.com', 'example.org') OR ends_with(host, '.example.com') OR ends_with(host, '.example.org')) AS trusted
        FROM h
    """,
    "snapshot_filename": rf"""
        WITH h AS (
            SELECT page_id, {_HOST} AS host, sha256(html) AS sha,
                regexp_extract(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1) AS last FROM pages
        ), s AS (
            SELECT *, regexp_replace(regexp_replace(regexp_replace(CASE WHEN last = '' THEN 'index' ELSE last END, '([^.])\.[^.]*$', '\1'),
                '[^0-9A-Za-z\x{{3400}}-\x{{9fff}}._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS stem FROM h
        )
        SELECT page_id, regexp_replace(left(regexp_replace(host, '[^0-9A-Za-z.-]+', '_', 'g') || '_' || CASE WHEN stem = '' THEN 'page' ELSE stem END
            || '_' || left(sha, 8), 170), '[._-]+$', '') || '.html' AS file_name FROM s
    """,
    "type_backfill": """
        SELECT page_id, t.kind AS document_type, t.mime AS mime_type, t.unit AS unit_type FROM pages LEFT JOIN (VALUES
            (0, 'pdf', 'application/pdf', 'page'),
            (1, 'docx', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', 'heading'),
            (2, 'pptx', 'application/vnd.openxmlformats-officedocument.presentationml.presentation', 'slide'),
            (3, 'markdown', 'text/markdown', 'heading'), (4, 'html', 'text/html', 'web_section')) t(k, kind, mime, unit) ON t.k = page_id % 6
    """,
    "file_validation": """
        SELECT page_id, CASE WHEN page_id % 5 = 3 THEN 'unsupported type' WHEN coalesce(strlen(html), 0) = 0 THEN 'empty file'
            WHEN page_id % 3 = 0 THEN 'declared type does not match'
            WHEN page_id % 5 = 1 AND NOT starts_with(html, '%PDF-') THEN 'no PDF header'
            WHEN page_id % 5 = 2 AND NOT starts_with(html, 'PK') THEN 'no archive'
            WHEN page_id % 5 IN (0, 4) AND contains(html, chr(0)) THEN 'binary content' ELSE 'ok' END AS outcome FROM pages
    """,
    "highlight_terms": r"""
        WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+(?:[._+/-][a-z0-9]+)*') AS toks FROM benchmark),
        e AS (SELECT item_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS n FROM t),
        f AS (SELECT item_id, tok, min(n) AS n FROM e WHERE length(tok) > 1 GROUP BY item_id, tok)
        SELECT b.item_id, coalesce(string_agg(tok, ' ' ORDER BY n), '') AS terms FROM benchmark b LEFT JOIN f USING (item_id) GROUP BY b.item_id
    """,
}
