"""Structured Streaming forms of the task operators. Sources are folders of Parquet rows (task_id, seq, ts, line or
status); every query works with ``trigger(availableNow=True)`` and with a running trigger alike."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fathom.operators import tasks as tk
from fathom.sources import files

LINES = "task_id long, seq long, ts timestamp, line string"
EVENTS = "task_id long, seq long, ts timestamp, status string"


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(folder)


def progress(lines: DataFrame, failure_words: tuple[str, ...] = ("failed", "错误")) -> DataFrame:
    """By task: highest progress, last line, and how it ended, if it did. One pre-aggregated state row a task."""
    failed = F.greatest(*(F.contains("line", F.lit(w)) for w in (*failure_words, "\0")))
    told = lines.groupBy("task_id").agg(
        F.coalesce(F.max(tk.line_progress(F.col("line"))), F.lit(0)).alias("progress"), F.max_by("line", "seq").alias("last_line"), F.bool_or(failed).alias("failed"), F.max("seq").alias("seq")
    )
    return told.withColumn("status", F.when(F.col("failed"), "failed").when(F.col("progress") >= 100, "completed").otherwise("running"))


def stalls(lines: DataFrame, gap: str = "180 seconds", late: str = "10 minutes") -> DataFrame:
    """Sessions of output by task: a session that closes is a stall. (Watermark and window are additions of ours.)"""
    watched = lines.withWatermark("ts", late)
    return watched.groupBy("task_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_lines"), F.max("seq").alias("seq")).select(
        "task_id", F.col("w.start").alias("started"), F.col("w.end").alias("stalled_at"), "n_lines", "seq"
    )


def guarded(events: DataFrame) -> DataFrame:
    """task_id, seq, before, status, accepted: each event against the state the task is in; refused events leave it
    as it is. Events of one batch are taken in order of seq."""

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else None
        out = []
        for row in pd.concat(list(rows)).sort_values("seq").itertuples():
            fine = now is None or now == row.status or row.status in tk.STEPS.get(now, [])
            out.append((key[0], row.seq, now, row.status, fine))
            now = row.status if fine else now
        state.update((now,))
        yield pd.DataFrame(out, columns=["task_id", "seq", "before", "status", "accepted"])

    return events.groupBy("task_id").applyInPandasWithState(
        step, "task_id long, seq long, before string, status string, accepted boolean", "status string", "append", GroupStateTimeout.NoTimeout
    )


def watch_once(spark: SparkSession, folder: str, manifest: str, pattern: str = "*") -> DataFrame:
    """One look at a folder: new and modified files against the manifest of the look before, which is then replaced by
    the next version. The first look only records. Call it from ``foreachBatch`` of a rate source, or a scheduler."""
    now = files.listing(spark, folder, pattern, content=False)
    versions = sorted(int(r.v) for r in _versions(spark, manifest).collect())
    stored = f"{manifest}/version={versions[-1] + 1 if versions else 0}"
    now.write.parquet(stored)
    kept = spark.read.parquet(stored)
    before = spark.read.parquet(f"{manifest}/version={versions[-1]}") if versions else kept
    return files.changed(before, kept)


def _versions(spark: SparkSession, manifest: str) -> DataFrame:
    """Versions that are whole, by the marks of their commits."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(manifest)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
    whole = [(p.getName().split("=")[1],) for p in found if "=" in p.getName() and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return spark.createDataFrame(whole, "v string")


__all__ = ["EVENTS", "LINES", "guarded", "progress", "read", "stalls", "watch_once"]
