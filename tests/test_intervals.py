"""Interval labels against a walk by hand."""

import random

import pytest

from fathom.operators import intervals

FOLDERS = "id long, parent_id long, name string"


def by_hand(rows):
    """id -> (root, depth, first, last), of folders that a root reaches."""
    ids = {i for i, _, _ in rows}
    below = {}
    for i, p, _ in rows:
        below.setdefault(p if p in ids else None, []).append(i)
    out = {}
    for root in below.get(None, []):
        place, stack = 0, [(root, 0, False)]
        while stack:
            i, depth, leaving = stack.pop()
            if leaving:
                out[i] = (*out[i], place)
            else:
                out[i] = (root, depth, place)
                stack.append((i, depth, True))
                stack += [(c, depth + 1, False) for c in sorted(below.get(i, []), reverse=True)]
            place += 1
    return out


def got(labels):
    return {r.id: (r.root_id, r.depth, r.first, r.last) for r in labels.collect()}


@pytest.mark.parametrize("most_rows", [10**6, 20])
def test_random_forests(spark, most_rows):
    r = random.Random(4)
    rows = [(i, r.randrange(i) if i > 3 and r.random() < 0.95 else None, f"n{i}") for i in range(300)]
    rows = [(i * 7 - 50, p if p is None else (0 if r.random() < 0.3 else p) * 7 - 50, n) for i, p, n in rows if i or p is None]
    labels = intervals.labelled(spark.createDataFrame(rows, FOLDERS).repartition(3), most_rows)
    assert got(labels) == by_hand(rows)
    counted = {r.id: r.n_below for r in labels.collect()}
    assert all(counted[i] == (last - first + 1) / 2 for i, (_, _, first, last) in by_hand(rows).items())


def test_a_deep_chain(spark):
    n = 10_000
    rows = [(i, i - 1 if i else None, "x") for i in range(n)]
    labels = intervals.labelled(spark.createDataFrame(rows, FOLDERS))
    made = got(labels)
    assert all(made[i] == (0, i, i, 2 * n - 1 - i) for i in (0, 1, 4999, n - 1)) and len(made) == n
    inside = intervals.scope(labels, spark.createDataFrame([(n - 3,)], "id long"))
    assert sorted((r.scope_id, r.id, r.depth) for r in inside.collect()) == [(n - 3, n - 3, 0), (n - 3, n - 2, 1), (n - 3, n - 1, 2)]


def test_nothing_is_sent_to_all_executors(spark):
    """Any broadcast fails here, even if by the size of the files it is worth it."""
    r = random.Random(9)
    rows = [(i, r.randrange(i) if i > 5 else None, "x") for i in range(400)] + [(i, i - 1 if i > 400 else None, "x") for i in range(400, 3000)]
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1k")
    try:
        assert got(intervals.labelled(spark.createDataFrame(rows, FOLDERS))) == by_hand(rows)
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_scopes_do_not_send_all_labels(spark, tmp_path):
    n = 60_000
    spark.range(n).selectExpr("id", "0L root_id", "id depth", "id first", f"{2 * n - 1}L - id last", f"{n}L - id n_below").write.parquet(f"{tmp_path}/labels")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "2m")
    try:
        inside = intervals.scope(spark.read.parquet(f"{tmp_path}/labels"), spark.createDataFrame([(n - 3,), (n - 1,), (n,)], "id long"))
        assert sorted((r.scope_id, r.id, r.depth) for r in inside.collect()) == [(n - 3, n - 3, 0), (n - 3, n - 2, 1), (n - 3, n - 1, 2), (n - 1, n - 1, 0)]
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_odd_folders(spark):
    rows = [(1, None, "a"), (1, None, "b"), (2, 1, None), (3, 99, "lost"), (4, 5, "x"), (5, 4, "y"), (6, 4, "under a cycle"), (7, 7, "itself"), (None, 1, "no id")]
    made = got(intervals.labelled(spark.createDataFrame(rows, FOLDERS)))
    assert made == {1: (1, 0, 0, 3), 2: (1, 1, 1, 2), 3: (3, 0, 0, 1), **dict.fromkeys((4, 5, 6, 7), (None,) * 4)}
    assert intervals.labelled(spark.createDataFrame([], FOLDERS)).count() == 0
