from datetime import datetime, timedelta

from fathom.streaming import tasks as st


def drained(df, spark, tmp_path, mode):
    name = f"t{abs(hash(str(tmp_path)))}"
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_progress_of_lines(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [(1, 0, at, "uploaded"), (1, 1, at, "parsing"), (1, 2, at, "ready"), (2, 0, at, "parsing"), (2, 1, at, "it failed")]
    spark.createDataFrame(rows, st.LINES).write.parquet(str(tmp_path / "in"))
    got = {r.task_id: (r.progress, r.status, r.last_line) for r in drained(st.progress(st.read(spark, str(tmp_path / "in"), st.LINES)), spark, tmp_path, "complete")}
    assert got == {1: (100, "completed", "ready"), 2: (20, "failed", "it failed")}


def test_guarded_states(spark, tmp_path):
    at = datetime(2024, 1, 1)
    path = ["uploaded", "ready", "parsing", "indexing", "ready"]
    spark.createDataFrame([(7, i, at, s) for i, s in enumerate(path)], st.EVENTS).write.parquet(str(tmp_path / "in"))
    got = drained(st.guarded(st.read(spark, str(tmp_path / "in"), st.EVENTS)), spark, tmp_path, "append")
    assert [r.accepted for r in sorted(got, key=lambda r: r.seq)] == [True, False, True, True, True]


def test_stalls(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [(1, i, at + timedelta(seconds=s), "x") for i, s in enumerate((0, 60, 600, 90_000))]
    spark.createDataFrame(rows, st.LINES).write.parquet(str(tmp_path / "in"))
    got = drained(st.stalls(st.read(spark, str(tmp_path / "in"), st.LINES)), spark, tmp_path, "append")
    assert sorted((r.n_lines, r.seq) for r in got) == [(1, 2), (2, 1)]


def test_watching_a_folder(spark, tmp_path):
    folder, manifest = tmp_path / "w", str(tmp_path / "m")
    folder.mkdir()
    (folder / "a.md").write_text("x")
    assert st.watch_once(spark, str(folder), manifest).count() == 0
    (folder / "b.md").write_text("y")
    (folder / "a.md").write_text("changed")
    assert {r.change for r in st.watch_once(spark, str(folder), manifest).collect()} == {"new", "modified"}
    assert st.watch_once(spark, str(folder), manifest).count() == 0
