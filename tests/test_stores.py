"""Durable stores and incremental ingestion: replays, failures half-way, any order of changes."""

import random

import pytest
from pyspark.sql import functions as F

from fathom.operators import ingestion as ing
from fathom.operators.stores import Store, sink


@pytest.fixture
def store(spark, tmp_path):
    return Store(str(tmp_path / "rows"), "owner", spark.createDataFrame([], "owner long, value string, folder long").schema, 8)


def rows(spark, *values):
    return spark.createDataFrame(list(values), "owner long, value string, folder long")


def held(store, spark):
    return sorted(map(tuple, store.rows(spark).collect()), key=repr)


def test_replace_delete_move(spark, store):
    assert held(store, spark) == []
    store.replace(rows(spark, (1, "a", 1), (1, "b", 1), (2, "c", 1), (None, "n", 2)))
    store.replace(rows(spark, (1, "d", 1)), spark.createDataFrame([(2,), (99,)], "owner long"))
    assert held(store, spark) == [(1, "d", 1), (None, "n", 2)]
    store.move(spark.createDataFrame([(1, 5), (7, 5), (None, None)], "owner long, to long"), "folder")
    assert held(store, spark) == [(1, "d", 5), (None, "n", None)]
    store.delete(spark.createDataFrame([(1,), (None,)], "owner long"))
    assert held(store, spark) == []
    assert store.replace(rows(spark).limit(0)) == []
    with pytest.raises(ValueError):
        Store("x", "bucket", spark.createDataFrame([], "bucket int").schema)


def test_a_replayed_batch_changes_nothing(spark, store):
    add = lambda current, changes: current.unionByName(changes)  # noqa: E731 - not idempotent by itself
    apply = sink(store, add)
    apply(rows(spark, (1, "a", 0), (2, "b", 0), (3, "c", 0)), 0)
    apply(rows(spark, (1, "d", 0)), 1)
    files = sorted(p for p in store.rows(spark).inputFiles())
    for batch in (1, 0, 1):
        apply(rows(spark, (1, "d", 0)), batch)
    assert sorted(store.rows(spark).inputFiles()) == files
    assert held(store, spark) == [(1, "a", 0), (1, "d", 0), (2, "b", 0), (3, "c", 0)]
    # A batch that died after some of its buckets: those are left, the others written.
    store.change(rows(spark, (1, "e", 0)), add, 2)
    assert len(store.change(rows(spark, (1, "e", 0), (2, "e", 0), (3, "e", 0)), add, 2)) in (1, 2)
    assert [r for r in held(store, spark) if r[1] == "e"] == [(1, "e", 0), (2, "e", 0), (3, "e", 0)]
    assert store.batches(spark).where("batch = 2").count() >= 2


def test_a_killed_write_leaves_the_old_rows(spark, store):
    store.replace(rows(spark, *((i, "old", 0) for i in range(40))))
    before = held(store, spark)

    def dies(current, changes):
        return current.unionByName(changes).withColumn("value", F.when(F.col("owner") == 17, F.raise_error(F.lit("killed"))).otherwise(F.lit("new")))

    with pytest.raises(Exception, match="killed"):
        store.change(rows(spark, *((i, "new", 0) for i in range(40))), dies, 5)
    assert held(store, spark) == before
    store.change(rows(spark, *((i, "new", 0) for i in range(40))), lambda c, n: n, 5)
    assert {r[1] for r in held(store, spark)} == {"new"}


def test_a_stream_is_applied_once(spark, store, tmp_path):
    add = lambda current, changes: current.unionByName(changes)
    source, applied = str(tmp_path / "in"), sink(store, add)
    for i in range(4):
        rows(spark, (i % 2, f"v{i}", i)).coalesce(1).write.mode("append").parquet(source)
    seen = []

    def flaky(df, batch):
        applied(df, batch)
        seen.append(batch)
        if len(seen) == 2:
            raise RuntimeError("stopped after the write, before the commit")

    def drain():
        stream = spark.readStream.schema(store.schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = stream.writeStream.foreachBatch(flaky).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        try:
            query.awaitTermination(120)
        except Exception as exc:
            assert "stopped after the write" in str(exc)

    drain()
    drain()
    assert seen.count(1) == 2 and held(store, spark) == [(0, "v0", 0), (0, "v2", 2), (1, "v1", 1), (1, "v3", 3)]


# --- ingestion ---------------------------------------------------------------------------------------------------


def log(seed=0, n_files=12):
    rng, found = random.Random(seed), []
    for file in [*range(n_files), None]:
        seq = 0
        for _ in range(rng.randint(1, 6)):
            seq += 1
            found.append((file, seq, "status", rng.choice(["uploaded", "parsing", "indexing"]), None, None))
            if rng.random() < 0.8:
                seq += 1
                found += [(file, seq, "chunk", None, i, f"{file}/{seq}/{i}") for i in range(rng.randint(1, 4))]
            seq += rng.choice([0, 1])
            found.append((file, seq, "status", rng.choice(["ready", "failed", "ready", "failed"]), None, None))
    return found


def plain(changes):
    """Walk each file's changes in order of seq."""
    states, texts = {}, {}
    for file in {c[0] for c in changes}:
        own = sorted((c for c in changes if c[0] == file), key=lambda c: (c[1], c[2] == "status", c[3] or ""))
        chunks, at, status = {}, None, None
        for _, seq, kind, state, index, text in own:
            if kind == "chunk":
                chunks = {} if at != seq else chunks
                at, chunks[index] = seq, text
            else:
                status = state
                chunks = {} if state == "failed" else chunks
        states[file] = (status, len(chunks))
        texts |= {(file, i): t for i, t in chunks.items()}
    return states, texts


@pytest.mark.parametrize("seed", range(3))
def test_any_order_of_changes_ends_alike(spark, tmp_path, seed):
    changes = log(seed)
    states, texts = plain(changes)
    frame = lambda c: spark.createDataFrame(c, ing.CHANGES)
    whole = ing.folded(frame([]), frame(changes + changes[:9]))
    kept = ing.store(spark, str(tmp_path / "s"), 4)
    apply = sink(kept, ing.folded)
    mixed = list(changes)
    random.Random(seed).shuffle(mixed)
    for batch in range(4):
        apply(frame(mixed[batch::4]), batch)
        if batch == 2:
            apply(frame(mixed[1::4]), 1)
            kept.change(frame(mixed[0::4]), ing.folded)  # a replay that the ledger does not know: folding is idempotent
    for found in (whole, kept.rows(spark)):
        assert {r.file_id: (r.status, r.chunk_count) for r in ing.files(found).collect()} == states
        assert {(r.file_id, r.chunk_index): r.text for r in ing.chunks(found).collect()} == texts
        bad = {(r.code, r.file_id) for r in ing.issues(found).collect()}
        assert bad == {("missing_vectors", f) for f, (s, n) in states.items() if s == "ready" and not n} | {("orphan_vectors", f) for f, (s, n) in states.items() if s != "ready" and n}


def test_compensations(spark):
    frame = lambda *c: spark.createDataFrame(list(c), ing.CHANGES)
    current = frame((1, 2, "chunk", None, 0, "a"), (1, 2, "chunk", None, 1, "b"), (2, 5, "chunk", None, 0, "c"), (3, 1, "chunk", None, 0, "d"))
    changes = frame((1, 3, "status", "failed", None, None), (2, 4, "status", "failed", None, None), (3, 2, "chunk", None, 0, "e"))
    assert sorted(map(tuple, ing.compensations(current, changes).collect())) == [(1, 2, 0), (1, 2, 1)]
    assert {(r.file_id, r.text) for r in ing.chunks(ing.folded(current, changes)).collect()} == {(2, "c"), (3, "e")}


def test_registration(spark):
    staged = spark.createDataFrame(
        [(1, "x", "upload", None), (2, "x", "url", "u1"), (3, "x", "url", "u2"), (4, "y", "upload", None), (5, "z", "upload", "ignored"), (6, None, "upload", None)],
        "staged_id long, sha256 string, source_kind string, source_url string",
    )
    records = spark.createDataFrame(
        [
            (10, "x", "ready", "upload", None, "/gone"), (11, "x", "ready", "upload", "other", "/there"), (12, "x", "ready", "upload", None, "/gone2"), (13, "x", "ready", "url", "u1", "/there"),
            (14, "y", "parsing", "upload", None, "/p"), (15, "y", "indexing", "url", "q", "/p"), (16, "z", "ready", "upload", None, "/gone"), (17, "x", "failed", "url", "u2", "/there"),
        ],
        "id long, sha256 string, status string, source_kind string, source_url string, path string",
    )
    listed = spark.createDataFrame([("/there",), ("/there",), ("/p",)], "path string")
    got = {r.staged_id: (r.outcome, r.record_id, r.stale) for r in ing.registered(staged, records, listed).collect()}
    assert got == {1: ("reuse", 11, 1), 2: ("reuse", 13, 0), 3: ("new", None, 0), 4: ("conflict", 15, 0), 5: ("new", None, 1), 6: ("new", None, 0)}
