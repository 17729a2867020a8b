"""Ingestion kept up incrementally: states and chunks of files from change rows, with failed attempts compensated.

Change rows are (file_id, seq, kind, status, chunk_index, text). ``status`` rows tell a file's state; ``chunk`` rows are what
one attempt wrote, all under the attempt's seq. A file's state is that of its highest seq. Its chunks are those of the
last attempt that wrote any, unless the file failed at a later seq (or the same): then the attempt is void, its
chunks are deleted as compensation, and the failed state stays. So an attempt also replaces the one before it.

``folded`` keeps just the rows that can still matter, by maxima of seq, and forgets the rest. Maxima do not hang on order or
on repetition: folding batch after batch, in any order and with replays, ends where folding all rows at once does. Under
a ``stores.Store`` by file_id it is an incremental table, and its sink takes a stream.

Defined cases: a file with chunks only has no state yet; repeated rows count once (of chunks of equal index in one attempt
the least text is kept); of two states at one seq the greater name counts; null file ids are one file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators.stores import Store
from fathom.session import cut

CHANGES = "file_id long, seq long, kind string, status string, chunk_index long, text string"


def _same_file(a: str, b: str) -> F.Column:
    return F.col(a).eqNullSafe(F.col(b))


def folded(current: DataFrame, changes: DataFrame) -> DataFrame:
    """The rows of both that matter: by file its last state and last failure, and the chunks that stand."""
    names = [c.split()[0] for c in CHANGES.split(", ")]
    both = current.select(*names).unionByName(changes.select(*names))
    is_state, is_chunk = F.col("kind") == "status", F.col("kind") == "chunk"
    tops = both.groupBy(F.col("file_id").alias("_file")).agg(
        F.max(F.when(is_state, F.struct("seq", "status"))).alias("_state"),
        F.max(F.when(is_state & (F.col("status") == "failed"), F.col("seq"))).alias("_failed"),
        F.max(F.when(is_chunk, F.col("seq"))).alias("_written"),
    )
    met = both.join(tops, _same_file("file_id", "_file"))
    is_last = is_state & (F.struct("seq", "status") == F.col("_state"))
    is_failure = is_state & (F.col("status") == "failed") & (F.col("seq") == F.col("_failed"))
    stands = is_chunk & (F.col("seq") == F.col("_written")) & (F.col("seq") > F.coalesce("_failed", F.lit(-1 << 62)))
    kept = met.where(is_last | is_failure | stands)
    return kept.groupBy("file_id", "seq", "kind", "status", "chunk_index").agg(F.min("text").alias("text"))


def files(rows: DataFrame) -> DataFrame:
    """file_id, status, chunk_count, failed_at (seq of the last failure) of folded rows."""
    is_state = F.col("kind") == "status"
    told = rows.groupBy("file_id").agg(
        F.max(F.when(is_state, F.struct("seq", "status"))).alias("state"),
        F.count_if(F.col("kind") == "chunk").alias("chunk_count"),
        F.max(F.when(is_state & (F.col("status") == "failed"), F.col("seq"))).alias("failed_at"),
    )
    return told.select("file_id", "state.status", "chunk_count", "failed_at")


def chunks(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'chunk'").select("file_id", "seq", "chunk_index", "text")


def compensations(current: DataFrame, changes: DataFrame) -> DataFrame:
    """file_id, seq, chunk_index: stored chunks that a change deletes because their attempt has failed (those that a later
    attempt replaces are not among them)."""
    failures = changes.where("kind = 'status' and status = 'failed'").groupBy(F.col("file_id").alias("_file")).agg(F.max("seq").alias("_failed"))
    return chunks(current).join(failures, _same_file("file_id", "_file") & (F.col("seq") <= F.col("_failed"))).select("file_id", "seq", "chunk_index")


def issues(rows: DataFrame) -> DataFrame:
    """code, level, file_id: ready files without chunks (error), chunks of files that are not ready (warning)."""
    told = files(rows)
    ready = F.coalesce(F.col("status") == "ready", F.lit(False))
    code = F.when(ready & (F.col("chunk_count") == 0), "missing_vectors").when(~ready & (F.col("chunk_count") > 0), "orphan_vectors")
    return told.select(code.alias("code"), F.when(ready, "error").otherwise("warning").alias("level"), "file_id").where("code is not null")


def store(spark, path: str, buckets: int = 64) -> Store:
    return Store(path, "file_id", spark.createDataFrame([], CHANGES).schema, buckets)


def registered(staged: DataFrame, records: DataFrame, listed: DataFrame) -> DataFrame:
    """What becomes of each staged document (staged_id, sha256, source_kind, source_url): outcome ``reuse``, ``conflict`` or
    ``new``, record_id of the record reused or in progress, and stale: how many ready records lost their file.

    A ready record (id, sha256, status, source_kind, source_url, path) is reused if its content, kind of source and, for web
    pages, URL are the same and its file is among ``listed`` (path): the least id. Ready records that match but whose
    file is gone count as stale as far as they were looked at (ids below the one reused; see ``stale``). Without one to
    reuse, the latest record of the same content that is in progress, whatever its source, is a conflict. A null hash equals
    nothing. Records are summed by content and source before they meet the staged documents."""
    found = stale(records, listed)
    ready = found.groupBy("_sha", "_kind", "_url").agg(F.min("_ready").alias("_ready"), F.count_if("is_stale").alias("_stale"))
    busy = records.where(F.col("status").isin("uploaded", "parsing", "indexing")).groupBy(F.col("sha256").alias("_busy_sha")).agg(F.max("id").alias("_busy"))
    same = (F.col("sha256") == F.col("_sha")) & F.col("source_kind").eqNullSafe(F.col("_kind")) & _url(F.col("source_kind"), F.col("source_url")).eqNullSafe(F.col("_url"))
    met = staged.join(ready, same, "left").join(busy, F.col("sha256") == F.col("_busy_sha"), "left")
    outcome = F.when(F.col("_ready").isNotNull(), "reuse").when(F.col("_busy").isNotNull(), "conflict").otherwise("new")
    return met.select(*staged.columns, outcome.alias("outcome"), F.coalesce("_ready", "_busy").alias("record_id"), F.coalesce("_stale", F.lit(0)).cast("long").alias("stale"))


def _url(kind: F.Column, url: F.Column) -> F.Column:
    """Only web pages are told apart by it."""
    return F.when(kind == "url", url)


def stale(records: DataFrame, listed: DataFrame) -> DataFrame:
    """id, is_stale, and what is compared (_sha, _kind, _url, _ready: the record reused) of ready records: stale ones lost
    their file and come before the record that is reused; they fail and lose their vectors."""
    there = records.where("status = 'ready'").join(listed.select("path").distinct().withColumn("_there", F.lit(True)), "path", "left")
    there = there.select("id", F.col("sha256").alias("_sha"), F.col("source_kind").alias("_kind"), _url(F.col("source_kind"), F.col("source_url")).alias("_url"), F.coalesce("_there", F.lit(False)).alias("_there"))
    best = there.groupBy("_sha", "_kind", "_url").agg(F.min(F.when(F.col("_there"), F.col("id"))).alias("_ready"))
    best = best.select(F.col("_sha").alias("b_sha"), F.col("_kind").alias("b_kind"), F.col("_url").alias("b_url"), "_ready")
    same = F.col("_sha").eqNullSafe(F.col("b_sha")) & F.col("_kind").eqNullSafe(F.col("b_kind")) & F.col("_url").eqNullSafe(F.col("b_url"))
    gone = ~F.col("_there") & (F.col("_ready").isNull() | (F.col("id") < F.col("_ready")))
    return there.join(cut(best, "best"), same).select("id", gone.alias("is_stale"), "_sha", "_kind", "_url", "_ready")
