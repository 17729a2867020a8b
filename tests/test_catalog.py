from datetime import datetime

from pyspark.sql import functions as F

from fathom.operators import catalog as ct
from fathom.operators import intake, snapshots, tree
from fathom.operators import tasks as tk

FOLDERS = "id long, parent_id long, name string"


def test_tree_with_cycle_missing_parent_and_depth(spark):
    rows = [(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, 3, "d"), (5, 4, "e"), (6, 7, "x"), (7, 6, "y"), (8, 99, "z")]
    folders = spark.createDataFrame(rows, FOLDERS)
    got = {r.id: (r.parent_id, r.depth) for r in tree.effective_parents(folders).collect()}
    assert got[5] == (4, 4) and got[6] == (None, 0) and got[7] == (None, 0) and got[8] == (None, 0)
    paths = {r.id: r.path for r in tree.paths(folders).collect()}
    assert paths[3] == "根目录 / a / b / c" and paths[6] == "根目录 / x"
    assert {(r.id, r.depth) for r in tree.descendants(folders, folders.where("id = 2")).collect()} == {(2, 0), (3, 1), (4, 2), (5, 3)}
    assert [r.id for r in tree.orphans(folders).collect()] == [8]
    left, files = tree.without_folder(folders, spark.createDataFrame([(1, 2), (2, 3)], "id long, course_id long"), 2)
    assert left.where("id = 3").first().parent_id is None and files.where("id = 1").first().course_id is None


def test_deep_trees(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None, f"n{i}") for i in range(200)], FOLDERS)
    assert {(r.id, r.depth) for r in tree.descendants(chain, chain.where("id = 0")).collect()} == {(i, i) for i in range(200)}
    assert {r.id: r.path for r in tree.paths(chain).where("id = 199").collect()}[199].count(" / ") == 200
    assert tree.effective_parents(chain).where("depth <> id").count() == 0
    ring = spark.createDataFrame([(0, 2, "a"), (1, 0, "b"), (2, 1, "c"), (3, 2, "tail"), (4, 3, "end")], FOLDERS)
    assert {(r.id, r.depth) for r in tree.descendants(ring, ring.where("id = 2")).collect()} == {(2, 0), (0, 1), (1, 2), (3, 1), (4, 2)}
    assert {r.parent_id for r in tree.effective_parents(ring).collect()} == {None}


def test_registration(spark):
    rows = [(1, "s", "failed"), (2, "s", "ready"), (3, "s", "ready"), (4, "t", "parsing"), (5, "t", "uploaded"), (6, "u", "failed")]
    got = {r.id: (r.outcome, r.canonical_id) for r in intake.registered(spark.createDataFrame(rows, "id long, sha string, status string"), ["sha"], ["id"]).collect()}
    assert got == {1: ("reuse", 2), 2: ("new", 2), 3: ("reuse", 2), 4: ("new", 4), 5: ("conflict", 4), 6: ("new", 6)}


def test_steps_progress_and_tail(spark):
    path = ["uploaded", "uploaded", "parsing", "ready", "failed", "uploaded"]
    events = spark.createDataFrame([(1, i, s) for i, s in enumerate(path)], "task_id long, seq long, status string")
    assert [r.seq for r in tk.illegal_steps(events).collect()] == [3]
    lines = spark.createDataFrame([(1, 0, "x"), (1, 1, "parsing"), (1, 2, "uploaded"), (1, 3, "ready")], "task_id long, seq long, line string")
    assert [r.progress for r in tk.progress(lines).orderBy("seq").collect()] == [0, 20, 20, 100]
    assert tk.log_tail(lines, chars=9).first().log == "aded\nread"[-9:] or len(tk.log_tail(lines, chars=9).first().log) == 9
    for text, want in (("wait 7 seconds", 8), ("no", None)):
        assert lines.limit(1).select(tk.cooldown(F.lit(text)).alias("c")).first().c == want
    assert lines.limit(1).select(tk.transfer_percent(F.lit("Progress 524288 of 1048576")).alias("c")).first().c == 50


def test_unknown_counts_stay_null(spark):
    schema = "r array<struct<answered:boolean,status:string,answered_at:string>>"
    rows = [([(None, "present", None), (None, "success", None), (None, "absent", None)],), ([(None, None, None)],), ([(True, "absent", None), (None, None, "2024")],)]
    assert [r.n for r in spark.createDataFrame(rows, schema).select(ct.answered_count(F.col("r")).alias("n")).collect()] == [2, None, 2]


def test_lifecycle(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, name string, n long")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, name string")
    assert sorted(map(tuple, ct.upserted(old, new, "k").collect())) == [(1, "a", 1), (2, "c", 2), (3, "d", None)]
    assert {r.k for r in ct.replaced(old, new, "k").collect()} == {1, 2, 3}
    assert {r.k for r in ct.replaced(old, new, "k", owners=old.where("k = 1")).collect()} == {2, 3}
    assert {r.k: r.extra for r in ct.upserted(old, new.withColumn("extra", F.lit(9)), "k").collect()} == {1: None, 2: 9, 3: 9}
    queue = spark.createDataFrame([(1, "queued"), (2, "running"), (3, "running")], "task_id long, status string")
    assert {(r.task_id, r.status) for r in tk.cancelled(queue, queue.where("task_id < 3")).collect()} == {(1, "cancelled"), (2, "cancelling"), (3, "running")}
    assert ct.migrated(old.drop("n"), {"n": ("long", 5)}).where("n = 5").count() == 2
    at = datetime(2024, 1, 1)
    row = spark.createDataFrame([("failed", 140, "m" * 2000, None, None)], "status string, progress int, message string, started_at timestamp, finished_at timestamp")
    got = tk.updated(row, F.lit(at)).first()
    assert got.progress == 100 and len(got.message) == 1000 and got.started_at is None and got.finished_at == at
    assert ct.state_summary(spark.createDataFrame([], "status string, retryable boolean")).first().asDict() == {"active": 0, "failed": 0, "retryable": 0}


def test_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "k long, v string")
    snapshots.store({"rows": rows}, str(tmp_path / "b"))
    assert snapshots.restore(spark, str(tmp_path / "b"))["rows"].collect() == rows.collect()
    part = next((tmp_path / "b/objects/rows").glob("_object=*"))
    rows.write.mode("append").parquet(str(part))
    assert snapshots.problems(spark, str(tmp_path / "b")) == ["rows of rows"]
    assert snapshots.duplicate_keys(rows.union(rows), ["k"]).first().n == 2


def test_conversation_lists_by_text_and_course(spark):
    talks = spark.createDataFrame([(1, "Limits", 3, False, 5), (2, "other", None, True, 1), (3, None, 3, None, 9), (4, "Limits 2", 4, False, None)], "conv_id long, title string, course_id long, pinned boolean, updated long")
    said = spark.createDataFrame([(2, "about LIMITS"), (3, "x"), (3, None)], "conv_id long, content string")
    courses = spark.createDataFrame([(3, "maths")], "course_id long, course_name string")
    got = lambda *a: [(r.conv_id, r.course_name, r.n_messages) for r in ct.listed_conversations(talks, said, courses, *a).orderBy("rank").collect()]
    assert got() == [(2, None, 1), (1, "maths", 0), (4, None, 0), (3, "maths", 2)]
    assert got(" limits ") == [(2, None, 1), (1, "maths", 0), (4, None, 0)]
    assert got("limits", 0) == [(2, None, 1)] and got("", 3) == [(1, "maths", 0), (3, "maths", 2)] and got("", None, 1) == [(2, None, 1)]


def test_paths_of_results(spark):
    folders = spark.createDataFrame([(1, None, "a"), (2, 1, "b")], "id long, parent_id long, name string")
    files = spark.createDataFrame([(1, 2), (2, None), (3, 77)], "id long, folder_id long")
    found = spark.createDataFrame([("folder", 2), ("file", 1), ("file", 2), ("file", 3)], "kind string, id long")
    got = {(r.kind, r.id): r.path for r in ct.with_paths(found, files, folders).collect()}
    assert got == {("folder", 2): "根目录 / a / b", ("file", 1): "根目录 / a / b", ("file", 2): "根目录", ("file", 3): "根目录"}
