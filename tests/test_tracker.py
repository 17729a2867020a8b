"""The tracker in batch and as a stream against a plain loop over each task's events."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from fathom.operators import tracking
from fathom.operators.tracking import Limits
from fathom.streaming import tracker

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
ZERO = int(START.timestamp() * 1000)
LIMITS = Limits(limit_ms=60_000, stall_ms=20_000, heartbeat_ms=5_000)
END = 10_000_000


def plain(events, limits, as_of):
    """status, ended, progress, lines, heartbeats, message by task: walk the events."""
    found = {}
    for task in {e[0] for e in events}:
        own = sorted((e[2], e[1], e[3], e[4]) for e in events if e[0] == task)
        began = heard = own[0][0]
        progress = lines = beats = 0
        fault = last = status = ended = None
        for at, _, kind, line in [*own, (as_of, 0, None, None)]:
            deadline = min(heard + limits.stall_ms, began + limits.limit_ms)
            k = 1
            while heard + k * limits.heartbeat_ms < min(at, deadline):
                beats, k = beats + 1, k + 1
            if deadline < at:
                status, ended = ("timeout" if deadline == began + limits.limit_ms else "stalled"), deadline
                break
            if kind in ("exit", "cancel", "lost"):
                status, ended = {"exit": "failed" if fault else "completed", "cancel": "cancelled", "lost": "interrupted"}[kind], at
                progress = 100 if status == "completed" else progress
                break
            if kind == "line":
                heard, lines = at, lines + 1
                progress = max(progress, tracker.progress_of(line or ""))
                told = (line or "").strip(" ") or None
                last = told or last
                fault = told if any(f in (line or "") for f in tracking.FAILURE) else fault
        found[task] = (status or "running", ended, progress, lines, beats, fault or last)
    return found


def generated(n_tasks=60, seed=1):
    rng, events = random.Random(seed), []
    words = ["uploaded", "parsing", "indexing", "plain words", "", None, "ready", "[致命异常] broke", "12 %\r"]
    for task in range(n_tasks):
        at, seq = rng.randint(0, 100_000), 0
        for _ in range(rng.randint(1, 14)):
            kind = rng.choices(["line", "exit", "cancel", "lost"], [20, 2, 1, 1])[0]
            events.append((f"t{task}", seq, at, kind, rng.choices(words, [3, 3, 3, 5, 1, 1, 1, 1, 3])[0] if kind == "line" else None))
            at, seq = at + rng.choice([0, 100, 900, 4000, 5000, 5001, 15_000, 20_000, 20_001]), seq + 1
    return events


def frame(spark, events):
    made = [(t, s, START + timedelta(milliseconds=at), k, line) for t, s, at, k, line in events]
    return spark.createDataFrame(made, tracker.EVENTS)


@pytest.mark.parametrize("most", [10**9, 40])
def test_batch_against_plain(spark, most):
    events = generated()
    got = tracking.endings(frame(spark, events), LIMITS, ZERO + END, most).collect()
    want = plain(events, LIMITS, END)
    assert {r.task_id: (r.status, r.ended_ms - ZERO if r.ended_ms else None, r.progress, r.n_lines, r.heartbeats, r.message) for r in got} == want
    assert {v[0] for v in want.values()} >= {"timeout", "stalled", "failed", "cancelled", "interrupted", "completed"}
    early = tracking.endings(frame(spark, events), LIMITS, ZERO + 1, most)
    assert early.where("status = 'running' and ended_ms is not null").count() == 0


def drained(spark, folder, out, checkpoint, limits=LIMITS):
    stream = spark.readStream.schema(tracker.EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    query = tracker.tracked(stream, limits, "30 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None


def test_stream_equals_batch_over_a_restart(spark, tmp_path):
    tracker.use_rocksdb(spark)
    events = generated(40, seed=3)
    by_time = sorted(events, key=lambda e: e[2] + random.Random(str(e)).randint(0, 20_000))  # out of order, within the watermark
    flush = [("flush", 0, END, "line", "x"), ("flush", 1, END + 10**9, "line", "x")]
    thirds = [by_time[i * len(by_time) // 3 : (i + 1) * len(by_time) // 3] for i in range(3)]
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for i, part in enumerate([*thirds, flush[:1], flush[1:]]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(folder)
        if i in (1, 4):  # two queries on one checkpoint: the second goes on where the first stopped
            drained(spark, folder, out, checkpoint)
    rows = [r for r in spark.read.parquet(out).collect() if r.task_id != "flush"]
    ends = {r.task_id: (r.event, r.at_ms - ZERO, r.progress, r.n_lines, r.heartbeats, r.message) for r in rows if r.event not in ("running", "update", "heartbeat")}
    want = plain(events, LIMITS, END)
    assert ends == want and len(ends) == sum(r.event not in ("running", "update", "heartbeat") for r in rows)
    assert sum(r.event == "heartbeat" for r in rows) == sum(w[4] for w in want.values())
    assert sorted(r.task_id for r in rows if r.event == "running") == sorted(want)
    updates = sum(r.event == "update" for r in rows)
    assert 0 < updates <= sum(w[3] for w in want.values())
    assert all(r.at_ms <= ends[r.task_id][1] + ZERO for r in rows)


def test_reports_are_paced(spark, tmp_path):
    tracker.use_rocksdb(spark)
    events = [("a", i, 10 * i, "line", "working") for i in range(100)] + [("b", i, 100 * i, "line", "5 %\r") for i in range(30)] + [("a", 200, 995, "line", "indexing"), ("a", 201, 996, "line", "[致命异常] x"), ("a", 202, 997, "exit", None)]
    frame(spark, events + [("z", 0, END, "line", "x"), ("z", 1, END * 10, "line", "x")]).coalesce(1).write.parquet(str(tmp_path / "in"))
    drained(spark, *(str(tmp_path / n) for n in ("in", "out", "cp")))
    rows = spark.read.parquet(str(tmp_path / "out"))
    told = [(r.at_ms - ZERO, r.progress) for r in rows.where("task_id = 'a' and event = 'update'").orderBy("at_ms").collect()]
    assert told == [(0, 0), (250, 0), (500, 0), (750, 0), (995, 75), (996, 75)]
    assert rows.where("task_id = 'b' and event = 'update'").count() == 3
    assert rows.where(F.col("task_id") == "a").where("event = 'failed'").first().message == "[致命异常] x"
