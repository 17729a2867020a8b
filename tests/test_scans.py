"""Running values in pieces against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from fathom.operators import scans
from fathom.operators import tasks as tk

KINDS = ("max", "max_before", "min", "sum_before", "last_before", "seen_before")


def plain(rows):
    found = {}
    for key in {k for k, _, _ in rows}:
        before = []
        for k, seq, v in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            real, own = [x for x in before if x is not None], [x for x in [*before, v] if x is not None]
            found[k, seq] = (
                max(own, default=None), max(real, default=None), min(own, default=None), sum(real) if real else None, before[-1] if before else None, real[-1] if real else None,
            )
            before.append(v)
    return found


def events(n=3000, hot=0.9):
    rng = random.Random(4)
    return [(7 if rng.random() < hot else rng.choice([None, 1, 2, 3]), seq, rng.choice([None, rng.randint(-50, 50)])) for seq in range(n)]


@pytest.mark.parametrize("most", [10**9, 100])
def test_running_values(spark, most):
    rows = events()
    made = spark.createDataFrame(rows, "key long, seq long, v long").repartition(5)
    got = scans.running(made, "key", ["seq"], {k: scans.Carry(k, F.col("v")) for k in KINDS}, most)
    assert {(r.key, r.seq): tuple(r[k] for k in KINDS) for r in got.collect()} == plain(rows)
    assert scans.running(made.limit(0), "key", ["seq"], {"m": scans.Carry("max", F.col("v"))}).count() == 0


def test_a_hot_key_is_spread(spark):
    rows = [(7 if i % 10 else i, i, i % 13) for i in range(20_000)]
    made = spark.createDataFrame(rows, "key long, seq long, v long")
    dealt = scans.running(made, "key", ["seq"], {"m": scans.Carry("max", F.col("v"))}, 100)
    assert dealt.count() == len(rows)
    pieces = made.repartitionByRange(200, "key", "seq").groupBy(F.spark_partition_id()).count()
    assert pieces.count() > 100 and pieces.agg({"count": "max"}).first()[0] < 1000


def test_only_keys_that_go_on_are_carried(spark, monkeypatch):
    rows = [(7 if i % 2 else i, i, i % 13) for i in range(4_000)]
    made, cuts = spark.createDataFrame(rows, "key long, seq long, v long"), {}
    kept = scans.cut
    monkeypatch.setattr(scans, "cut", lambda df, name: cuts.setdefault(name, kept(df, name)))
    got = scans.running(made, "key", ["seq"], {k: scans.Carry(k, F.col("v")) for k in KINDS}, 100)
    assert {(r.key, r.seq): tuple(r[k] for k in KINDS) for r in got.collect()} == plain(rows)
    assert 0 < cuts["carried"].count() < cuts["pieces"].select("_piece").distinct().count()


def test_task_operators_in_pieces_equal_windows(spark, monkeypatch):
    rng = random.Random(8)
    states = list(tk.STEPS)
    rows = [(1 if rng.random() < 0.9 else rng.randint(2, 5), seq, rng.choice(states)) for seq in range(2000)]
    made = spark.createDataFrame(rows, "task_id long, seq long, status string").select(
        "*", F.col("status").alias("line"), F.timestamp_seconds(F.col("seq") * F.col("seq") % 100_003).alias("ts"), F.concat(F.col("status"), F.lit("\r\npart\n"), F.col("seq").cast("string")).alias("chunk")
    )
    jobs = [tk.progress, tk.illegal_steps, lambda d: tk.stalls(d, 60), tk.framed]
    whole = [sorted(map(str, f(made).collect())) for f in jobs]
    windows = scans.running
    monkeypatch.setattr(tk, "running", lambda *a: windows(*a, 50))
    assert [sorted(map(str, f(made).collect())) for f in jobs] == whole and all(whole)
