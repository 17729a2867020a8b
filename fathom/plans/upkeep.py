"""Queries that keep a catalogue in order: labels of places, backfills, gates, queues, engines, exports with citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import text as tx
from fathom.operators import catalog as ct
from fathom.operators import intake
from fathom.operators import retrieval as rt
from fathom.operators import tasks as tk
from fathom.session import table


def _pick(column: str, *values: str | None) -> F.Column:
    """One of the values by remainder of the column."""
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (F.col(column) % len(values) + 1).cast("int"))


def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of every kind, with and without an index and a section of their own."""
    docs = table(spark, sf_dir, "documents")
    kind = _pick("doc_id", "page", "slide", "heading", "web_section")
    section = F.when(F.col("doc_id") % 3 == 0, tx.BODY).when(F.col("doc_id") % 3 == 1, F.col("source"))
    index = F.col("doc_id") % 5
    return docs.select("doc_id", rt.location_label(kind, index, section).alias("place"), rt.section_suffix(kind, section).alias("suffix"))


def engine_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every type of document with every engine asked for, an old name among them."""
    kind = _pick("doc_id", "pdf", "docx", "pptx", "html", "markdown")
    wanted = F.element_at(F.array(*(F.lit(w) for w in ("pypdf", "marker", "mineru"))), (F.floor(F.col("doc_id") / 5) % 3 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", intake.effective_engine(kind, wanted).alias("engine"))


def hash_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old rows with a null or empty hash, some of whose contents are gone."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.col("doc_id").alias("id"), _pick("doc_id", None, "", "known").alias("sha256"))
    return intake.hashed(files, docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))


def metric_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as files and turns as chunks; some files are complete, some not ready, some PDFs with pages."""
    turns = table(spark, sf_dir, "conversations")
    chunks = turns.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("chunk_index"), (F.col("turn") % 4).alias("location_index"), F.when(F.col("role") == "assistant", F.concat(F.lit("e"), F.col("turn").cast("string"))).otherwise("").alias("engine"))
    number = lambda m, r, v: F.when(F.col("id") % m == r, v).otherwise(0).cast("long")
    files = turns.select(F.col("conv_id").alias("id")).distinct().select(
        "id", F.when(F.col("id") % 7 == 0, "failed").otherwise("ready").alias("status"), F.when(F.col("id") % 2 == 0, "pdf").otherwise("markdown").alias("document_type"),
        number(4, 0, 11).alias("page_count"), number(3, 0, 5).alias("chunk_count"), F.when(F.col("id") % 3 == 0, "marker").alias("engine"), number(3, 0, 9).alias("unit_count"),
    )
    return intake.measured(files, chunks).select("id", "status", "chunk_count", "unit_count", "engine")


def root_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey") % 3).alias("folder_id"))
    return files.where(ct.in_folder("folder_id", 0))


def answer_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks of a user against a threshold of 5; those of every eleventh user are unknown."""
    told = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("n"))
    return told.select("user_id", tk.gate(F.when(F.col("user_id") % 11 != 0, F.col("n")), 5).alias("action"))


def open_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tk.unsolved(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("my_status")))


def import_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second file of the queue has estimates, 0 among them."""
    size = F.col("n_chars") * 1000
    half = F.col("doc_id") % 2 == 0
    items = table(spark, sf_dir, "documents").select(size.alias("size"), F.when(half, F.col("doc_id") % 3 * size).alias("disk_bytes"), F.when(half, F.col("doc_id") % 4).alias("seconds"))
    return tk.queue_totals(items)


def transfer_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Download lines of a user, noise and totals of 0 among them: those that tell a new percent."""
    a, b = F.floor(F.col("event_id") / 40) % 8, F.when(F.col("event_id") % 10 == 3, 0).otherwise(7)
    line = F.when(F.col("event_id") % 6 == 0, "downloading").otherwise(F.concat(F.lit(" Progress  "), a.cast("string"), F.lit(" of "), b.cast("string")))
    return tk.transfer_changes(table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), line.alias("line"))).select("task_id", "seq", F.col("percent").cast("long").alias("percent"))


def export_with_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers cite two sources, one of them without a name on every third turn."""
    turns = table(spark, sf_dir, "conversations")
    cited = F.when(F.col("role") == "assistant", F.array(F.lit("a.pdf"), F.when(F.col("turn") % 3 != 0, F.concat("role", F.lit(".md")))))
    titles = turns.select("conv_id").distinct().withColumn("title", F.col("conv_id").cast("string"))
    out = ct.exported(turns.select("conv_id", "turn", "role", F.col("text").alias("content"), cited.alias("cited")), titles)
    return out.select("conv_id", F.md5(F.col("markdown").cast("binary")).alias("markdown_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        source_labels, engine_choice, hash_backfill, metric_backfill, root_files, answer_gate, open_problems, import_totals, transfer_changes, export_with_citations,
    )
}

ORACLE_SQL = {
    "source_labels": """WITH p AS (SELECT doc_id, ['page', 'slide', 'heading', 'web_section'][doc_id % 4 + 1] AS kind, doc_id % 5 AS i,
            CASE doc_id % 3 WHEN 0 THEN '正文' WHEN 1 THEN source END AS section FROM documents
        ), q AS (SELECT *, coalesce(section, '') NOT IN ('', '正文') AS named FROM p)
        SELECT doc_id, CASE WHEN kind = 'page' AND i > 0 THEN '第 ' || i || ' 页' WHEN kind = 'slide' AND i > 0 THEN '第 ' || i || ' 张幻灯片'
            WHEN named THEN '章节：' || section WHEN kind = 'web_section' AND i > 0 THEN '网页章节 ' || i ELSE '位置未标注' END AS place,
            CASE WHEN kind IN ('page', 'slide') AND named THEN '｜' || section ELSE '' END AS suffix FROM q""",
    "engine_choice": """WITH k AS (SELECT doc_id, ['pdf', 'docx', 'pptx', 'html', 'markdown'][doc_id % 5 + 1] AS kind, ['pymupdf', 'marker', 'mineru'][doc_id // 5 % 3 + 1] AS wanted FROM documents)
        SELECT doc_id, CASE WHEN kind = 'pdf' THEN wanted WHEN kind = 'markdown' THEN 'markdown' WHEN kind = 'html' THEN CASE WHEN wanted = 'marker' THEN 'marker' ELSE 'html' END
            WHEN wanted IN ('marker', 'mineru') THEN wanted ELSE 'python-' || kind END AS engine FROM k""",
    "hash_backfill": """SELECT doc_id AS id, CASE WHEN doc_id % 3 = 2 THEN 'known' WHEN doc_id % 5 <> 0 AND text IS NOT NULL THEN sha256(text)
        WHEN doc_id % 3 = 1 THEN '' END AS sha256 FROM documents""",
    "metric_backfill": """WITH c AS (SELECT conv_id AS id, count(*) AS n, max(turn % 4) AS units, arg_min('e' || turn, turn) FILTER (role = 'assistant') AS engine FROM conversations GROUP BY conv_id)
        SELECT id, CASE WHEN id % 7 = 0 THEN 'failed' ELSE 'ready' END AS status,
            (CASE WHEN id % 3 = 0 THEN 5 WHEN id % 7 = 0 THEN 0 ELSE n END)::BIGINT AS chunk_count,
            (CASE WHEN id % 3 = 0 THEN 9 WHEN id % 7 = 0 THEN 0 WHEN id % 4 = 0 THEN 11 ELSE units END)::BIGINT AS unit_count,
            CASE WHEN id % 3 = 0 THEN 'marker' WHEN id % 7 <> 0 THEN engine END AS engine FROM c""",
    "root_files": "SELECT c_custkey, CASE WHEN c_nationkey % 5 <> 0 THEN c_nationkey % 3 END AS folder_id FROM customer WHERE c_nationkey % 5 = 0 OR c_nationkey % 3 = 0",
    "answer_gate": """SELECT user_id, CASE WHEN user_id % 11 = 0 THEN 'skip' WHEN count(*) FILTER (event_type = 'click') < 5 THEN 'wait' ELSE 'go' END AS action FROM events GROUP BY user_id""",
    "open_problems": "SELECT doc_id AS id, quality AS my_status FROM labels WHERE doc_id <> 0 AND quality IS DISTINCT FROM 0",
    "import_totals": """SELECT coalesce(sum(CASE WHEN doc_id % 2 = 0 AND doc_id % 3 <> 0 THEN doc_id % 3 * n_chars * 1000 ELSE n_chars * 1000 END), 0)::BIGINT AS bytes,
        coalesce(sum(CASE WHEN doc_id % 2 = 0 AND doc_id % 4 <> 0 THEN doc_id % 4 ELSE greatest(2, floor(n_chars * 1000 / 1048576 + 0.5)) END), 0)::BIGINT AS seconds FROM documents""",
    "transfer_changes": """WITH t AS (SELECT user_id AS task_id, event_id AS seq, CASE WHEN event_id % 10 = 3 THEN 0 ELSE event_id // 40 % 8 * 100 // 7 END AS percent FROM events WHERE event_id % 6 <> 0)
        SELECT task_id, seq, percent::BIGINT AS percent FROM t QUALIFY percent IS DISTINCT FROM lag(percent) OVER (PARTITION BY task_id ORDER BY seq)""",
    "export_with_citations": """WITH b AS (SELECT conv_id, turn, '## ' || CASE role WHEN 'user' THEN '用户' WHEN 'assistant' THEN '助手' ELSE role END || chr(10) || chr(10) || text || chr(10)
            || CASE WHEN role = 'assistant' THEN chr(10) || '引用：a.pdf、' || CASE WHEN turn % 3 <> 0 THEN 'assistant.md' ELSE '未知资料' END || chr(10) ELSE '' END AS block FROM conversations)
        SELECT conv_id, md5('# ' || conv_id || chr(10) || chr(10) || string_agg(block, chr(10) ORDER BY turn, block)) AS markdown_md5 FROM b GROUP BY conv_id""",
}
