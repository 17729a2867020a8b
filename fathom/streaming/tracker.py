"""The task tracker as a stream: one stateful processor for progress, reports, heartbeats, silence, limits and cancels.

Events wait in a map state until the watermark has passed them, so tasks see them in order of (ts, seq) however they
arrive; timers wake a task at its next event, its next heartbeat and its deadline. All state is a key's own and lies in the
state store: a restart from the checkpoint goes on where it stopped. The ends are those of ``tracking.endings``.

Reports (``update``) are paced as they are in event time: at most one in ``REPORT_MS``, but at once where progress
changes or a failure is told; lines that redraw (they end in a carriage return) count once in ``REDRAW_MS``.
After its end a task keeps a mark for ``forget_ms``, by which late events are ignored; then its state is gone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from fathom.operators.tasks import MESSAGE_CHARS, PROGRESS
from fathom.operators.tracking import ENDS, FAILURE, REDRAW_MS, REPORT_MS, Limits

EVENTS = "task_id string, seq long, ts timestamp, kind string, line string"
OUT = "task_id string, event string, at_ms long, progress long, n_lines long, heartbeats long, message string"
_TASK = "began long, heard long, beat long, progress long, n_lines long, heartbeats long, fault string, last string, reported long, redrawn long, ended long"
_COLUMNS = [c.split()[0] for c in OUT.split(", ")]
_NAMES = [c.split()[0] for c in _TASK.split(", ")]


def progress_of(line: str) -> int:
    return next((p for words, p in PROGRESS if any(w in line for w in words)), 0)


class Tracker(StatefulProcessor):
    def __init__(self, limits: Limits, forget_ms: int) -> None:
        self.limits, self.forget_ms = limits, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", _TASK)
        self.waiting = handle.getMapState("waiting", "at long, seq long", "kind string, line string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            for at, seq, kind, line in zip(batch["at"], batch["seq"], batch["kind"], batch["line"], strict=True):
                self.waiting.updateValue((int(at), int(seq)), (kind, line))
                first = int(at) if first is None else min(first, int(at))
        if first is not None:
            self.handle.registerTimer(max(first + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        stored = self.task.get()
        t = dict(zip(_NAMES, stored, strict=True)) if stored else None
        if t and t["ended"] is not None and t["ended"] + self.forget_ms < now:
            self.task.clear()
            self.waiting.clear()
            return
        out: list[tuple] = []
        pairs = [((k[0], k[1]), (v[0], v[1])) for k, v in self.waiting.iterator()]
        due = sorted((p for p in pairs if p[0][0] < now), key=lambda p: p[0])
        for (at, seq), (kind, line) in due:
            self.waiting.removeKey((at, seq))
            t = self._start(key, at, out) if t is None else t
            if t["ended"] is None:
                self._silence(key, t, at, out)
            if t["ended"] is None:
                self._event(key, t, at, kind, line or "", out)
        if t is not None:
            if t["ended"] is None:
                self._silence(key, t, now, out)
            self.task.update(tuple(t[n] for n in _NAMES))
            later = [p[0][0] + 1 for p in pairs if p[0][0] >= now]
            wake = [t["ended"] + self.forget_ms + 1] if t["ended"] is not None else [self._deadline(t) + 1, t["beat"] + self.limits.heartbeat_ms + 1]
            self.handle.registerTimer(max(now + 1, min(later + wake)))
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    def _row(self, key: Any, t: dict, event: str, at: int, message: str | None = None) -> tuple:
        return (key[0], event, at, t["progress"], t["n_lines"], t["heartbeats"], t["fault"] or t["last"] if message is None else message)

    def _start(self, key: Any, at: int, out: list[tuple]) -> dict:
        t = dict.fromkeys(_NAMES) | {"began": at, "heard": at, "beat": at, "progress": 0, "n_lines": 0, "heartbeats": 0}
        out.append(self._row(key, t, "running", at))
        return t

    def _deadline(self, t: dict) -> int:
        return min(t["heard"] + self.limits.stall_ms, t["began"] + self.limits.limit_ms)

    def _silence(self, key: Any, t: dict, until: int, out: list[tuple]) -> None:
        """Heartbeats strictly before ``until`` and the deadline, then the deadline if it is before ``until``."""
        deadline = self._deadline(t)
        while t["beat"] + self.limits.heartbeat_ms < min(until, deadline):
            t["beat"] += self.limits.heartbeat_ms
            t["heartbeats"] += 1
            out.append(self._row(key, t, "heartbeat", t["beat"]))
        if deadline < until:
            self._end(key, t, "timeout" if deadline == t["began"] + self.limits.limit_ms else "stalled", deadline, out)

    def _event(self, key: Any, t: dict, at: int, kind: str, line: str, out: list[tuple]) -> None:
        if kind in ENDS:
            status = ENDS[kind] or ("failed" if t["fault"] else "completed")
            t["progress"] = 100 if status == "completed" else t["progress"]
            self._end(key, t, status, at, out)
            return
        t["heard"] = t["beat"] = at
        t["n_lines"] += 1
        told = line.strip(" ")[-MESSAGE_CHARS:]
        before, failed = t["progress"], any(f in line for f in FAILURE)
        t["progress"] = max(before, progress_of(line))
        t["fault"], t["last"] = told if failed and told else t["fault"], told or t["last"]
        if line.endswith("\r") and t["redrawn"] is not None and at - t["redrawn"] < REDRAW_MS and t["progress"] == before and not failed:
            return
        t["redrawn"] = at if line.endswith("\r") else t["redrawn"]
        if t["reported"] is None or at - t["reported"] >= REPORT_MS or t["progress"] != before or failed:
            t["reported"] = at
            out.append(self._row(key, t, "update", at, told))

    def _end(self, key: Any, t: dict, status: str, at: int, out: list[tuple]) -> None:
        t["ended"] = at
        out.append(self._row(key, t, status, at))


def tracked(events: DataFrame, limits: Limits, late: str = "10 minutes", forget_ms: int = 86_400_000) -> DataFrame:
    """A stream of ``OUT`` rows (running, update, heartbeat and an end for each task) from a stream of ``EVENTS``. Needs
    ``spark.sql.streaming.stateStore.providerClass`` to be the RocksDB one (see ``use_rocksdb``)."""
    watched = events.withWatermark("ts", late).select(F.col("task_id").cast("string").alias("task_id"), "seq", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.coalesce("kind", F.lit("line")).alias("kind"), "line")
    return watched.groupBy("task_id").transformWithStateInPandas(Tracker(limits, forget_ms), OUT, "Append", "EventTime")


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


__all__ = ["EVENTS", "OUT", "Tracker", "tracked", "use_rocksdb"]
