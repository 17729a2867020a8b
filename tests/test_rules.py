import json

from pyspark.sql import functions as F

from fathom.functions import nested
from fathom.operators import rules


def test_counts_in_json_of_unknown_shape(spark):
    cases = [
        ({"rollcall": {"answerCount": "12"}}, 12),
        ({"students": [{"status": "present"}, {"status": "answered"}, {"status": "absent"}]}, 2),
        ({"title": "x", "n": 4}, None),
        ({"data": {"attendance": {"total": "8"}}}, 8),
        ([{"answered": True}, {"answered": False}, {"signed": True}], 2),
        ({"answered_students": [1, 2, 3]}, 3),
        ({"present_count": -1}, None),
    ]
    cases += [
        ([{"status": s} for s in ("success", "normal", "waiting", "late")], 2),
        ([{"status": "completed"}, {"status": "absent"}], 1),
        ({"attendees": [1, 2]}, 2),
        ([{"note": 1}, {"answered_at": "2024"}, {"status": True}], 1),
        ({"x": {"signed_users": [1], "total": 9}, "attend": {"n_total": 7.9, "flag_count": True}}, 7),
    ]
    texts = [json.dumps(p) for p, _ in cases] + ["not json", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, payload string")
    assert {r.id: r.n for r in nested.answer_counts(rows, "id", "payload").collect()} == {i: w for i, w in enumerate([w for _, w in cases] + [None, None])}
    wrapped = spark.createDataFrame([(1, '{"data":{"rollcalls":[{"rollcall_id":42},{"b":1}]}}'), (2, "{}")], "id long, payload string")
    assert [(r.id, r["items"]) for r in nested.wrapped_lists(wrapped, "id", "payload", "rollcall_id").collect()] == [(1, ['{"rollcall_id":42}', '{"b":1}'])]


def test_rules(spark):
    one = lambda v, e: spark.createDataFrame([(v,)], "x string").select(e(F.col("x")).alias("y")).first().y
    assert [one(v, rules.name_problem) for v in (" a ", "  ", None, "x" * 101)] == [None, "empty", "empty", "too long"]
    assert [one(v, lambda c: rules.inside(c, "/up")) for v in ("/up/a", "/up/../b", "/upper/a")] == [True, False, False]
    assert one("x <answer> B. forty two </answer>", rules.tagged_answer) == "forty two"
    assert one("3", lambda c: rules.label(c.cast("int"), {3: "passed"})) == "passed"
    queue = spark.createDataFrame([(1, "ready"), (2, "processing"), (3, "failed")], "id int, status string")
    assert sorted(map(tuple, rules.saved_queue(queue).collect())) == [(2, "queued"), (3, "failed")]
    folders = spark.createDataFrame([(1, None, "Top"), (2, 1, "Sub")], "id long, parent_id long, name string")
    paths = spark.createDataFrame([(["top", "SUB", "new", "newer"],), (["other"],), ([" "],)], "parts array<string>")
    got = {r.path: (r.id, r.depth) for r in rules.ensured_folders(folders, paths).collect()}
    assert got == {"top": (1, 1), "other": (None, 1), "top/sub": (2, 2), "top/sub/new": (None, 3), "top/sub/new/newer": (None, 4)}
    deep = spark.createDataFrame([([f"p{i}" for i in range(20)],)], "parts array<string>")
    assert rules.ensured_folders(folders, deep).count() == 20
