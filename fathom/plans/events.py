"""Task and event queries: tasks are users, states follow the event types, lines carry the markers of those states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import nested
from fathom.operators import catalog as ct
from fathom.operators import tasks as tk
from fathom.operators import tracking
from fathom.session import table

STATES = {"signup": "uploaded", "view": "parsing", "click": "indexing", "purchase": "ready", "error": "failed"}
STATUSES = {"signup": "success", "view": "waiting", "click": "completed", "purchase": "absent", "error": "late"}
TASK_STATES = {"signup": "queued", "view": "running", "click": "cancelling", "purchase": "completed", "error": "failed"}

LIMITS = tracking.Limits(limit_ms=36_000_000, stall_ms=18_000_000, heartbeat_ms=3_600_000)
AS_OF_MS = 1_709_251_200_000  # the start of March 2024


def _mapped(c: str, values: dict[str, str]) -> F.Column:
    return F.coalesce(*(F.when(F.col(c) == k, v) for k, v in values.items()))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), "ts", "event_type", _mapped("event_type", STATES).alias("status"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).withColumn("line", F.concat(F.lit("step "), F.col("seq").cast("string"), F.lit(" "), "status"))


def task_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the latest state of each task; tasks of even number can be retried."""
    latest = _events(spark, sf_dir).withColumn("status", _mapped("event_type", TASK_STATES))
    return ct.state_summary(tk.current(latest).withColumn("retryable", F.col("task_id") % 2 == 0))


def task_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = _events(spark, sf_dir).withColumn("status", _mapped("event_type", TASK_STATES))
    return tk.interrupted(tk.current(latest)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def task_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tk.progress(_lines(spark, sf_dir)).select("task_id", "seq", "progress")


def task_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tk.current(_events(spark, sf_dir))


def task_log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tk.log_tail(_lines(spark, sf_dir), chars=200).select("task_id", F.md5(F.col("log").cast("binary")).alias("log_md5"))


def illegal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tk.illegal_steps(_events(spark, sf_dir)).select("task_id", "seq", "before", "status")


def stalled_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tk.stalls(_events(spark, sf_dir), 3600).select("task_id", "seq", "gap_seconds")


def active_time_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in (("08:00", "09:50"), ("13:10", "15:00"))))
    inside = _events(spark, sf_dir).withColumn("active", tk.in_slots(F.col("ts"), slots))
    return inside.groupBy("active", "event_type").agg(F.count(F.lit(1)).alias("n"))


def nested_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts from payloads of five shapes around each event's own field."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    total = F.concat(F.lit('{"data":{"attendance":{"total":"'), k, F.lit('"}}}'))
    state = _mapped("event_type", STATUSES)
    states = F.concat(F.lit('{"x":[{"status":"'), state, F.lit('"},{"note":1},{"status":" Normal "}]}'))
    people = F.concat(F.lit('{"attendees":['), F.array_join(F.sequence(F.lit(0), F.pmod(k.cast("int"), F.lit(4))), ","), F.lit("]}"))
    flags = F.concat(F.lit('[{"is_answered":'), (F.col("event_type") == "view").cast("string"), F.lit(',"status":"success"},{"answered_at":"2024"}]'))
    count = F.concat(F.lit('{"a":{"b":[{"presentCount":'), k, F.lit("}]}}"))
    shapes = F.element_at(F.array(total, states, people, flags, count), (F.col("event_id") % 5 + 1).cast("int"))
    return nested.answer_counts(events.select("event_id", shapes.alias("payload")), "event_id", "payload")


def task_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task is a user's day: errors are lines of failure, purchases exits, a small k a cancel; all else is output."""
    events = table(spark, sf_dir, "events")
    cancelled = F.get_json_object("props", "$.k").cast("int") < 5
    word = F.when(F.col("event_type") == "error", tracking.FAILURE[0]).otherwise(_mapped("event_type", STATES))
    made = events.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("task_id"),
        F.col("event_id").alias("seq"),
        "ts",
        F.when(cancelled, "cancel").when(F.col("event_type") == "purchase", "exit").otherwise("line").alias("kind"),
        F.concat(F.lit("step "), F.col("event_id").cast("string"), F.lit(" "), word).alias("line"),
    )
    return tracking.endings(made, LIMITS, AS_OF_MS)


QUERIES = {f.__name__: f for f in (
    task_endings, task_summary, task_recovery, task_progress, task_latest, task_log_tail, illegal_transitions, stalled_sessions, active_time_slots, nested_counts
)}

_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATES.items())
_TASK_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TASK_STATES.items())
_EVENTS = f"e AS (SELECT user_id AS task_id, event_id AS seq, ts, event_type, CASE event_type {_CASE} END AS status FROM events)"
_LATEST = f"l AS (SELECT user_id AS task_id, CASE arg_max(event_type, event_id) {_TASK_CASE} END AS status FROM events GROUP BY user_id)"

ORACLE_SQL = {
    # A row at AS_OF_MS stands for the end of the watch; the first row at which a task has ended tells all.
    "task_endings": f"""WITH e AS (
            SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS task_id, epoch_us(ts) // 1000 AS ms, event_id AS seq,
                CASE WHEN json_extract_string(props, '$.k')::INT < 5 THEN 'cancel' WHEN event_type = 'purchase' THEN 'exit' ELSE 'line' END AS kind,
                'step ' || event_id || ' ' || CASE event_type WHEN 'error' THEN '[致命异常]' {_CASE} END AS line FROM events
        ), s AS (
            SELECT task_id, ms, seq, kind, CASE WHEN kind = 'line' THEN line END AS line FROM e
            UNION ALL SELECT task_id, {AS_OF_MS}, 9223372036854775807, 'now', NULL FROM e GROUP BY task_id
        ), w AS (
            SELECT *, min(ms) OVER p AS began, max(CASE WHEN kind = 'line' THEN ms END) OVER b AS heard, count(line) OVER b AS n_lines,
                max(CASE WHEN line LIKE '%uploaded' THEN 5 WHEN line LIKE '%parsing' THEN 20 WHEN line LIKE '%indexing' THEN 75 END) OVER b AS progress,
                last_value(CASE WHEN line LIKE '%[致命异常]%' THEN line END IGNORE NULLS) OVER b AS fault, last_value(line IGNORE NULLS) OVER b AS last
            FROM s WINDOW p AS (PARTITION BY task_id), b AS (PARTITION BY task_id ORDER BY ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), d AS (SELECT *, coalesce(heard, began) AS since, least(coalesce(heard, began) + {LIMITS.stall_ms}, began + {LIMITS.limit_ms}) AS deadline FROM w
        ), m AS (SELECT *, deadline < ms AS late, greatest(0, (least(ms, deadline) - since - 1) // {LIMITS.heartbeat_ms}) AS silent FROM d
        ), c AS (
            SELECT *, sum(silent) OVER (PARTITION BY task_id ORDER BY ms, seq) AS beats FROM m
        ), f AS (
            SELECT * FROM c WHERE late OR kind IN ('exit', 'cancel') QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY ms, seq) = 1
        )
        SELECT task_id, CASE WHEN late AND deadline = began + {LIMITS.limit_ms} THEN 'timeout' WHEN late THEN 'stalled' WHEN kind = 'cancel' THEN 'cancelled'
                WHEN fault IS NULL THEN 'completed' ELSE 'failed' END AS status, began AS started_ms, CASE WHEN late THEN deadline ELSE ms END AS ended_ms,
            CASE WHEN NOT late AND kind = 'exit' AND fault IS NULL THEN 100 ELSE coalesce(progress, 0) END::BIGINT AS progress,
            n_lines, beats::BIGINT AS heartbeats, coalesce(fault, last) AS message FROM f""",
    "task_summary": f"""WITH {_LATEST}
        SELECT count(*) FILTER (status IN ('queued', 'running', 'cancelling')) AS active, count(*) FILTER (status IN ('failed', 'interrupted')) AS failed,
            count(*) FILTER (status IN ('failed', 'interrupted') AND task_id % 2 = 0) AS retryable FROM l""",
    "task_recovery": f"""WITH {_LATEST}
        SELECT CASE WHEN status IN ('queued', 'running', 'cancelling') THEN 'interrupted' ELSE status END AS status, count(*) AS n FROM l GROUP BY 1""",
    "task_progress": f"""WITH {_EVENTS}
        SELECT task_id, seq, coalesce(max(CASE status WHEN 'uploaded' THEN 5 WHEN 'parsing' THEN 20 WHEN 'indexing' THEN 75 WHEN 'ready' THEN 100 END)
            OVER (PARTITION BY task_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS progress FROM e""",
    "task_latest": f"""WITH {_EVENTS}
        SELECT task_id, arg_max(status, seq) AS status, min(ts) AS started, max(ts) AS updated, count(*) AS n_events FROM e GROUP BY task_id""",
    "task_log_tail": f"""WITH {_EVENTS}
        SELECT task_id, md5(right(string_agg('step ' || seq || ' ' || status, chr(10) ORDER BY seq), 200)) AS log_md5 FROM e GROUP BY task_id""",
    "illegal_transitions": f"""WITH {_EVENTS}, p AS (SELECT *, lag(status) OVER (PARTITION BY task_id ORDER BY seq) AS before FROM e)
        SELECT task_id, seq, before, status FROM p WHERE before IS NOT NULL AND before <> status AND (before, status) NOT IN (
            ('uploaded', 'parsing'), ('uploaded', 'failed'), ('parsing', 'indexing'), ('parsing', 'failed'), ('indexing', 'ready'), ('indexing', 'failed'),
            ('ready', 'uploaded'), ('ready', 'failed'), ('failed', 'uploaded'))""",
    "stalled_sessions": f"""WITH {_EVENTS}, p AS (SELECT *, lag(ts) OVER (PARTITION BY task_id ORDER BY seq) AS last FROM e)
        SELECT task_id, seq, (floor(epoch(ts)) - floor(epoch(last)))::BIGINT AS gap_seconds FROM p WHERE floor(epoch(ts)) - floor(epoch(last)) > 3600""",
    "active_time_slots": """
        SELECT strftime(ts, '%H:%M') BETWEEN '08:00' AND '09:50' OR strftime(ts, '%H:%M') BETWEEN '13:10' AND '15:00' AS active, event_type, count(*) AS n
        FROM events GROUP BY ALL
    """,
    "nested_counts": """WITH k AS (SELECT event_id, event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
        SELECT event_id, CASE event_id % 5 WHEN 1 THEN 1 + CASE WHEN event_type IN ('signup', 'click') THEN 1 ELSE 0 END
            WHEN 2 THEN k % 4 + 1 WHEN 3 THEN 1 + (event_type = 'view')::INT ELSE k END::BIGINT AS n FROM k""",
}
