"""Queries that write, replay and read back: durable rows by owner, incremental ingestion, registration of staged files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators import ingestion as ing
from fathom.operators import snapshots
from fathom.operators.stores import Store
from fathom.session import scratch_path, table


def durable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders kept by customer: the customers of one nation get new rows, those of another none, those of a third are
    deleted, those of a fourth moved; a batch whose number has come already changes nothing."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), "c_nationkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("item"), F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 10).alias("folder"))
    of = lambda n: customers.where(F.col("c_nationkey") == n).select("owner")
    store = Store(scratch_path(spark, "rows"), "owner", orders.schema, 16)
    new = of(3).select("owner", (-F.col("owner")).alias("item"), F.lit("N").alias("status"), F.lit(0).cast("long").alias("folder"))
    store.replace(orders, batch=0)
    store.replace(new, of(4), batch=1)
    store.delete(of(5), batch=2)
    store.move(of(6).withColumn("to", F.lit(99).cast("long")), "folder", batch=3)
    store.replace(new.limit(0), of(6), batch=3)
    return store.rows(spark)


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as files: clicks write one to four chunks, the other events tell states."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    state = F.when(F.col("event_type") == "signup", "uploaded").when(F.col("event_type") == "view", "parsing").when(F.col("event_type") == "purchase", "ready").when(F.col("event_type") == "error", "failed")
    base = events.select(F.col("user_id").alias("file_id"), F.col("event_id").alias("seq"), state.alias("status"), k.alias("k"))
    states = base.where("status is not null").select("file_id", "seq", F.lit("status").alias("kind"), "status", F.lit(None).cast("long").alias("chunk_index"), F.lit(None).cast("string").alias("text"))
    spread = base.where("status is null").select("file_id", "seq", F.explode(F.sequence(F.lit(0).cast("long"), F.pmod("k", F.lit(4)).cast("long"))).alias("chunk_index"))
    text = F.concat_ws("/", F.col("seq").cast("string"), F.col("chunk_index").cast("string"))
    return states.unionByName(spread.select("file_id", "seq", F.lit("chunk").alias("kind"), F.lit(None).cast("string").alias("status"), "chunk_index", text.alias("text")))


def ingestion_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes in three batches that are out of order, one of them twice; then state, chunks and issue of each file."""
    changes = _changes(spark, sf_dir)
    store = ing.store(spark, scratch_path(spark, "ingestion"), 16)
    for batch, part in enumerate((2, 0, 2, 1)):
        store.change(changes.where(F.col("seq") % 3 == part), ing.folded, batch)
    rows = store.rows(spark)
    last = ing.chunks(rows).groupBy("file_id").agg(F.max(F.struct("seq", "chunk_index")).alias("x")).select("file_id", F.concat_ws("/", F.col("x.seq").cast("string"), F.col("x.chunk_index").cast("string")).alias("last_chunk"))
    return ing.files(rows).join(last, "file_id", "left").join(ing.issues(rows).select("file_id", "code"), "file_id", "left")


def staged_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a record and as a staged upload or page; the files of two thirds of the records are there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("sha256"), F.col("source").alias("source_url"))
    kind = lambda n: F.when(F.floor(F.col("doc_id") / n) % 2 == 0, "upload").otherwise("url").alias("source_kind")
    status = F.when(F.col("doc_id") % 4 == 2, "parsing").when(F.col("doc_id") % 4 == 3, "failed").otherwise("ready")
    path = F.concat(F.lit("/files/"), F.col("doc_id").cast("string"))
    records = docs.select(F.col("doc_id").alias("id"), "sha256", status.alias("status"), kind(4), "source_url", path.alias("path"))
    staged = docs.select(F.col("doc_id").alias("staged_id"), "sha256", kind(2), "source_url")
    return ing.registered(staged, records, docs.where("doc_id % 3 <> 0").select(path.alias("path"))).drop("sha256", "source_url")


def snapshot_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in two snapshots, changed in between; the first comes back, with the parts each of them wrote."""
    held = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    folder = scratch_path(spark, "snapshots")
    first = snapshots.store({"customer": held}, folder, "first", parts=16, created_ms=1)
    changed = held.withColumn("c_name", F.when(F.col("c_custkey") == 7, "changed").otherwise(F.col("c_name")))
    second = snapshots.store({"customer": changed}, folder, "second", parts=16, created_ms=2)
    return snapshots.restore(spark, folder, 0)["customer"].select("*", F.lit(first["customer"]).cast("long").alias("wrote_first"), F.lit(second["customer"]).cast("long").alias("wrote_second"))


QUERIES = {f.__name__: f for f in (durable_rows, ingestion_state, staged_registration, snapshot_restore)}

ORACLE_SQL = {
    "snapshot_restore": "SELECT c_custkey, c_name, c_acctbal, c_mktsegment, 16::BIGINT AS wrote_first, 1::BIGINT AS wrote_second FROM customer",
    "durable_rows": """
        SELECT o_custkey AS owner, o_orderkey AS item, o_orderstatus AS status, CASE WHEN c_nationkey = 6 THEN 99 ELSE o_custkey % 10 END::BIGINT AS folder
        FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE c_nationkey IS NULL OR c_nationkey NOT IN (3, 4, 5)
        UNION ALL SELECT c_custkey, -c_custkey, 'N', 0 FROM customer WHERE c_nationkey = 3
    """,
    "ingestion_state": """
        WITH e AS (SELECT user_id AS file_id, event_id AS seq, event_type AS t, json_extract_string(props, '$.k')::INT AS k FROM events
        ), f AS (
            SELECT file_id, max(seq) FILTER (t = 'error') AS failed_at, max(seq) FILTER (t = 'click') AS written, arg_max(k, seq) FILTER (t = 'click') AS k,
                arg_max(CASE t WHEN 'signup' THEN 'uploaded' WHEN 'view' THEN 'parsing' WHEN 'purchase' THEN 'ready' ELSE 'failed' END, seq) FILTER (t <> 'click') AS status
            FROM e GROUP BY file_id
        ), n AS (SELECT *, CASE WHEN written > coalesce(failed_at, -1) THEN k % 4 + 1 ELSE 0 END::BIGINT AS chunk_count FROM f)
        SELECT file_id, status, chunk_count, failed_at, CASE WHEN chunk_count > 0 THEN written || '/' || (chunk_count - 1) END AS last_chunk,
            CASE WHEN status = 'ready' AND chunk_count = 0 THEN 'missing_vectors' WHEN status IS DISTINCT FROM 'ready' AND chunk_count > 0 THEN 'orphan_vectors' END AS code FROM n
    """,
    "staged_registration": """
        WITH d AS (SELECT doc_id, md5(text) AS sha, source FROM documents
        ), r AS (
            SELECT doc_id AS id, sha, source AS url, CASE doc_id % 4 WHEN 2 THEN 'parsing' WHEN 3 THEN 'failed' ELSE 'ready' END AS status,
                CASE WHEN doc_id // 4 % 2 = 0 THEN 'upload' ELSE 'url' END AS kind, doc_id % 3 <> 0 AS there FROM d
        ), s AS (SELECT doc_id AS staged_id, sha, source AS url, CASE WHEN doc_id // 2 % 2 = 0 THEN 'upload' ELSE 'url' END AS source_kind FROM d
        ), m AS (
            SELECT staged_id, source_kind, min(id) FILTER (status = 'ready' AND kind = source_kind AND (kind <> 'url' OR r.url IS NOT DISTINCT FROM s.url) AND there) AS ready,
                max(id) FILTER (status = 'parsing') AS busy,
                list(id) FILTER (status = 'ready' AND kind = source_kind AND (kind <> 'url' OR r.url IS NOT DISTINCT FROM s.url) AND NOT there) AS gone
            FROM s LEFT JOIN r USING (sha) GROUP BY staged_id, source_kind
        )
        SELECT staged_id, source_kind, CASE WHEN ready IS NOT NULL THEN 'reuse' WHEN busy IS NOT NULL THEN 'conflict' ELSE 'new' END AS outcome,
            coalesce(ready, busy) AS record_id, len(list_filter(coalesce(gone, []), lambda i: ready IS NULL OR i < ready))::BIGINT AS stale FROM m
    """,
}
