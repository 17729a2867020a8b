"""Task logs and status events in batch: progress, transitions, stalls, tails. Streams use the same expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.operators.scans import Carry, running

# Allowed steps between states, and progress by words of a log line, first match wins.
STEPS = {"uploaded": ["parsing", "failed"], "parsing": ["indexing", "failed"], "indexing": ["ready", "failed"], "ready": ["uploaded", "failed"], "failed": ["uploaded"]}
PROGRESS = (
    (("uploaded", "开始处理", "开始初始化"), 5),
    (("parsing", "正在启用", "正在安装"), 20),
    (("OCR", "提取文字", "下载"), 40),
    (("切片", "验证"), 60),
    (("indexing", "向量化"), 75),
    (("批量写入", "探针"), 90),
    (("ready", "初始化完成", "成功转化"), 100),
)
ACTIVE = ["queued", "running", "cancelling"]
LOG_CHARS, MESSAGE_CHARS = 12_000, 1_000


def line_progress(line: Column) -> Column:
    """Percent that a line tells, or null."""
    return F.coalesce(*(F.when(F.greatest(*(F.contains(line, F.lit(w)) for w in words)), p) for words, p in PROGRESS))


def progress(lines: DataFrame, key: str = "task_id") -> DataFrame:
    """Adds progress so far, which never falls."""
    told = running(lines, key, ["seq"], {"progress": Carry("max", line_progress(F.col("line")))})
    return told.withColumn("progress", F.coalesce("progress", F.lit(0)).cast("long"))


def allowed(before: Column, after: Column) -> Column:
    """Staying is allowed, and so is any first state."""
    steps = F.coalesce(*(F.when(before == k, after.isin(v)) for k, v in STEPS.items()), F.lit(False))
    return before.isNull() | (before == after) | steps


def illegal_steps(events: DataFrame, key: str = "task_id") -> DataFrame:
    """Events whose state may not follow the one before."""
    return running(events, key, ["seq"], {"before": Carry("last_before", F.col("status"))}).where(~allowed(F.col("before"), F.col("status")))


def current(events: DataFrame, key: str = "task_id") -> DataFrame:
    """The latest state of each task and when it began."""
    return events.groupBy(key).agg(F.max_by("status", "seq").alias("status"), F.min("ts").alias("started"), F.max("ts").alias("updated"), F.count(F.lit(1)).alias("n_events"))


def stalls(events: DataFrame, seconds: int, key: str = "task_id") -> DataFrame:
    """Gaps longer than ``seconds`` between an event and the next of its task."""
    gap = (F.unix_timestamp("ts") - F.unix_timestamp("last")).cast("long")
    return running(events, key, ["seq"], {"last": Carry("last_before", F.col("ts"))}).withColumn("gap_seconds", gap).where(F.col("gap_seconds") > seconds)


def log_tail(lines: DataFrame, key: str = "task_id", chars: int = LOG_CHARS) -> DataFrame:
    """The last ``chars`` characters of each task's log. Only the lines that can reach the tail are gathered: those
    with at most ``chars`` characters after them."""
    back = lines.withColumn("_back", -F.col("seq"))
    after = running(back, key, ["_back"], {"after": Carry("sum_before", (F.length("line") + 1).cast("long"))})
    near = after.where(F.coalesce("after", F.lit(0)) <= chars)
    joined = near.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("log"))
    return joined.withColumn("log", F.right("log", F.lit(chars)))


def updated(tasks: DataFrame, as_of: Column) -> DataFrame:
    """Clamps and stamps: progress 0 to 100, message cut, start kept once set, end set on terminal states."""
    over = F.col("status").isin("completed", "failed", "cancelled")
    return tasks.withColumns(
        {
            "progress": F.greatest(F.lit(0), F.least(F.lit(100), "progress")),
            "message": F.substring("message", 1, MESSAGE_CHARS),
            "started_at": F.coalesce("started_at", F.when(F.col("status") == "running", as_of)),
            "finished_at": F.when(over, F.coalesce("finished_at", as_of)),
        }
    )


def interrupted(tasks: DataFrame) -> DataFrame:
    """After a restart, whatever was active is interrupted."""
    return tasks.withColumn("status", F.when(F.col("status").isin(ACTIVE), "interrupted").otherwise(F.col("status")))


def retried(tasks: DataFrame) -> DataFrame:
    """New queued tasks for failed, interrupted or cancelled ones that can be run again; retry_of names the old one."""
    again = tasks.where(F.col("status").isin("failed", "interrupted", "cancelled") & F.col("retryable"))
    return again.withColumns({"retry_of": F.col("task_id"), "task_id": F.concat(F.lit("retry-"), F.col("task_id").cast("string")), "status": F.lit("queued")})


def cancelled(tasks: DataFrame, wanted: DataFrame, key: str = "task_id") -> DataFrame:
    """Waiting tasks that are ``wanted`` (task_id) end at once, running ones are told to; others stay."""
    marked = tasks.join(wanted.select(key).distinct().withColumn("_wanted", F.lit(True)), key, "left")
    status = F.when(F.col("_wanted") & (F.col("status") == "queued"), "cancelled").when(F.col("_wanted") & (F.col("status") == "running"), "cancelling").otherwise(F.col("status"))
    return marked.withColumn("status", status).drop("_wanted")


def framed(chunks: DataFrame, key: str = "task_id") -> DataFrame:
    """task_id, line_no, line: whole lines from chunks (seq, chunk) that break anywhere; an unfinished last line counts.

    A line is told by its number: the line breaks before it. Only the pieces of one line are gathered."""
    split = chunks.withColumn("pieces", F.split(F.regexp_replace("chunk", "\\r\\n?", "\n"), "\n")).withColumn("breaks", F.size("pieces") - 1)
    counted = running(split, key, ["seq"], {"before": Carry("sum_before", F.col("breaks").cast("long"))})
    pieces = counted.select(key, "seq", F.coalesce("before", F.lit(0)).alias("before"), F.posexplode("pieces").alias("pos", "piece"))
    parts = F.array_sort(F.collect_list(F.struct("seq", "pos", "piece")))
    return pieces.groupBy(key, (F.col("before") + F.col("pos")).alias("line_no")).agg(F.array_join(F.transform(parts, lambda p: p["piece"]), "").alias("line"))


def in_slots(ts: Column, slots: Column) -> Column:
    """Within one of array<struct<start, end>> of HH:MM, both included; no slots means always."""
    now = F.date_format(ts, "HH:mm")
    return slots.isNull() | (F.size(slots) == 0) | F.exists(slots, lambda s: now.between(s["start"], s["end"]))


def cooldown(message: Column) -> Column:
    """Seconds to wait that a message names, plus one."""
    return F.regexp_extract(message, r"([0-9]+) seconds?", 1).try_cast("int") + 1


def transfer_percent(line: Column) -> Column:
    """Of ``Progress a of b``."""
    done, total = (F.regexp_extract(line, r"^\s*Progress\s+([0-9]+)\s+of\s+([0-9]+)\s*$", i).try_cast("double") for i in (1, 2))
    return F.when(total > 0, F.floor(100 * done / total).cast("int")).when(total == 0, 0)


def transfer_changes(lines: DataFrame, key: str = "task_id") -> DataFrame:
    """Lines (seq, line) whose percent differs from that of the transfer line before them; other lines do not count."""
    told = lines.withColumn("percent", transfer_percent(F.col("line"))).where(F.col("percent").isNotNull())
    return running(told, key, ["seq"], {"_before": Carry("last_before", F.col("percent"))}).where(~F.col("percent").eqNullSafe(F.col("_before"))).drop("_before")


def gate(count: Column, threshold: int) -> Column:
    """``go`` from the threshold on, ``wait`` below it, ``skip`` where the count is unknown; no threshold, no question."""
    return F.lit("go") if threshold <= 0 else F.when(count.isNull(), "skip").when(count < threshold, "wait").otherwise("go")


def unsolved(problems: DataFrame) -> DataFrame:
    """Problems (id, my_status) still to do: an id that is null, empty or 0 is missing, state 0 has passed, null has not."""
    return problems.where(F.coalesce(~F.col("id").cast("string").isin("", "0"), F.lit(False)) & ~F.col("my_status").eqNullSafe(F.lit(0)))


def queue_totals(items: DataFrame) -> DataFrame:
    """One row: bytes and seconds of a queue (size, disk_bytes, seconds); an estimate of null or 0 gives way to one by size."""
    by_size = F.greatest(F.lit(2), F.floor(F.col("size") / 1048576 + 0.5))
    given = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit(0)), other).cast("long")
    return items.agg(F.coalesce(F.sum(given("disk_bytes", F.col("size"))), F.lit(0)).alias("bytes"), F.coalesce(F.sum(given("seconds", by_size)), F.lit(0)).alias("seconds"))
