"""How tasks end: by themselves, by a cancel, by silence, or by taking too long.

Events are (task_id, seq, ts, kind, line); kind is ``line`` (output), ``exit`` (the process has ended), ``cancel`` (asked
for) or ``lost`` (the reader has gone). A task starts with its first event. It is ``timeout`` once ``limit`` has passed
since its start, ``stalled`` once ``stall`` has passed without output; an event at the very instant of a deadline is still in
time, and of two deadlines at one instant the limit counts. Whatever comes after an end is ignored. Times are whole
milliseconds, events are ordered by (ts, seq).

``endings`` is the batch form; ``streaming.tracker`` finds the same ends as the events arrive.

Defined cases: blank lines are output but tell nothing; a null line is blank; a null kind is a line; null task ids are one
task; events of equal ts and seq have no order between them; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.operators.scans import MOST_ROWS, Carry, largest_key, running
from fathom.operators.tasks import MESSAGE_CHARS, line_progress

# What marks a line of failure, the pace of heartbeats and of reports.
FAILURE = ("[致命异常]", "___ENGINE_INIT_FAILED___")
HEARTBEAT_MS, REPORT_MS, REDRAW_MS = 15_000, 250, 1_000
ENDS = {"exit": None, "cancel": "cancelled", "lost": "interrupted"}  # the end of an exit hangs on what was said


@dataclass(frozen=True)
class Limits:
    limit_ms: int = 900_000
    stall_ms: int = 180_000
    heartbeat_ms: int = HEARTBEAT_MS


def failing(line: Column) -> Column:
    return F.coalesce(F.greatest(*(F.contains(line, F.lit(t)) for t in FAILURE)), F.lit(False))


def beats(since: Column, until: Column, deadline: Column, every: int) -> Column:
    """Heartbeats in the silence from ``since`` on, each strictly before ``until`` and the deadline."""
    bound = F.least(until, deadline)
    return F.greatest(F.lit(0), F.floor((bound - since - 1) / every)).cast("long")


def endings(events: DataFrame, limits: Limits, as_of_ms: int, most_rows: int = MOST_ROWS) -> DataFrame:
    """task_id, status (``running`` if it has no end before ``as_of_ms``), started_ms, ended_ms, progress, n_lines,
    heartbeats, message: a row for each task. What a row says of a task is what held before it, so one scan along
    the tasks and one aggregate by task find the first row at, or before, which each has ended."""
    at, kind = F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.coalesce("kind", F.lit("line"))
    made = events.select("task_id", at, "seq", kind.alias("kind"), F.when(kind == "line", F.coalesce("line", F.lit(""))).alias("line"))
    is_line = F.col("kind") == "line"
    said = F.when(is_line & (F.trim("line") != ""), F.right(F.trim("line"), F.lit(MESSAGE_CHARS)))
    carries = {
        "began": Carry("min", F.col("at")),
        "heard": Carry("max_before", F.when(is_line, F.col("at"))),
        "progress": Carry("max_before", line_progress(F.col("line"))),
        "fault": Carry("seen_before", F.when(failing(F.col("line")), said)),
        "last": Carry("seen_before", said),
        "lines": Carry("sum_before", is_line.cast("long")),
    }
    largest = largest_key(events, "task_id")
    told = running(made, "task_id", ["at", "seq"], carries, most_rows, largest)
    since = F.coalesce("heard", "began")
    deadline = F.least(since + limits.stall_ms, F.col("began") + limits.limit_ms)
    told = told.withColumns({"since": since, "deadline": deadline, "late": deadline < F.col("at")})
    ends = F.col("late") | F.col("kind").isin(*ENDS)
    # Heartbeats of the silence before a row; those of rows after the first end do not count.
    told = told.withColumns({"ends": ends, "silent": beats(F.col("since"), F.col("at"), F.col("deadline"), limits.heartbeat_ms)})
    place = F.struct("at", "seq")
    told = running(told, "task_id", ["at", "seq"], {"over": Carry("max_before", ends), "beaten": Carry("sum_before", F.when(is_line, F.col("silent")).otherwise(0))}, most_rows, largest)
    open_ = ~F.coalesce("over", F.lit(False))
    facts = F.struct("at", "kind", "late", "deadline", "began", "progress", "fault", "last", "lines", (F.col("silent") + F.coalesce("beaten", F.lit(0))).alias("beats"))
    # Of a task that goes on: what its rows say together.
    held = told.where(open_).groupBy("task_id").agg(
        F.min_by(F.when(F.col("ends"), facts), F.when(F.col("ends"), place)).alias("e"),
        F.min("began").alias("began"),
        F.max(F.when(is_line, F.col("at"))).alias("heard"),
        F.max(line_progress(F.col("line"))).alias("progress"),
        F.max_by(F.when(failing(F.col("line")), said), F.when(failing(F.col("line")) & said.isNotNull(), place)).alias("fault"),
        F.max_by(said, F.when(said.isNotNull(), place)).alias("last"),
        F.count_if(is_line).alias("lines"),
        F.sum(F.when(is_line, F.col("silent"))).alias("beats"),
    )
    rest_since = F.coalesce("heard", "began")
    rest_deadline = F.least(rest_since + limits.stall_ms, F.col("began") + limits.limit_ms)
    rest_over = rest_deadline < as_of_ms
    silence = lambda limit_first: F.when(limit_first, "timeout").otherwise("stalled")
    ended = F.col("e").isNotNull()
    by_kind = F.when(F.col("e.kind") == "exit", F.when(F.col("e.fault").isNotNull(), "failed").otherwise("completed")).otherwise(F.coalesce(*(F.when(F.col("e.kind") == k, v) for k, v in ENDS.items() if v)))
    status = (
        F.when(ended & F.col("e.late"), silence(F.col("e.deadline") == F.col("e.began") + limits.limit_ms))
        .when(ended, by_kind)
        .when(rest_over, silence(rest_deadline == F.col("began") + limits.limit_ms))
        .otherwise("running")
    )
    done = ended & ~F.col("e.late") & (F.col("e.kind") == "exit") & F.col("e.fault").isNull()
    return held.select(
        "task_id",
        status.alias("status"),
        F.col("began").alias("started_ms"),
        F.when(ended, F.when(F.col("e.late"), F.col("e.deadline")).otherwise(F.col("e.at"))).when(rest_over, rest_deadline).alias("ended_ms"),
        F.when(done, 100).otherwise(F.coalesce(F.when(ended, F.col("e.progress")).otherwise(F.col("progress")), F.lit(0))).cast("long").alias("progress"),
        F.coalesce(F.when(ended, F.col("e.lines")).otherwise(F.col("lines")), F.lit(0)).cast("long").alias("n_lines"),
        F.when(ended, F.col("e.beats"))
        .otherwise(F.coalesce("beats", F.lit(0)) + beats(rest_since, F.lit(as_of_ms), rest_deadline, limits.heartbeat_ms))
        .cast("long")
        .alias("heartbeats"),
        F.when(ended, F.coalesce("e.fault", "e.last")).otherwise(F.coalesce("fault", "last")).alias("message"),
    )
