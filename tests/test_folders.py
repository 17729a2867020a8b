"""The folder source: what it primes with, emits, and picks up again after a restart."""

import os

import pytest

from fathom.streaming import folders


@pytest.fixture
def place(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    return tmp_path


def drained(spark, place, pattern="*", fails=False):
    """Runs the stream until nothing is left; the rows of all its batches."""
    got = []

    def take(rows, batch):
        if fails:
            raise RuntimeError("stopped on purpose")
        got.extend((os.path.relpath(r.path, place / "in"), r.change, r.length) for r in rows.collect())

    stream = folders.watched(spark, str(place / "in"), str(place / "listings"), pattern, 3)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", str(place / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return sorted(got)


def put(place, name, text, at):
    (place / "in" / name).write_text(text)
    os.utime(place / "in" / name, (at, at))


def test_primes_emits_and_resumes(spark, place):
    put(place, "a.md", "x", 1000)
    put(place, "deep/b c.md", "", 1000)
    assert drained(spark, place) == []
    put(place, "a.md", "longer", 2000)
    put(place, "deep/新.md", "n", 2000)
    put(place, "deep/b c.md", "", 2000)
    assert drained(spark, place) == [("a.md", "modified", 6), ("deep/b c.md", "modified", 0), ("deep/新.md", "new", 1)]
    assert drained(spark, place) == []
    (place / "in" / "a.md").unlink()
    assert drained(spark, place) == []
    put(place, "a.md", "back", 3000)
    assert drained(spark, place) == [("a.md", "new", 4)]


def test_a_batch_that_failed_comes_again_as_it_was(spark, place):
    assert drained(spark, place) == []
    put(place, "a.md", "one", 1000)
    with pytest.raises(Exception, match="stopped on purpose"):
        drained(spark, place, fails=True)
    put(place, "b.md", "two", 2000)
    assert drained(spark, place) == [("a.md", "new", 3)]
    assert drained(spark, place) == [("b.md", "new", 3)]


def test_listings_that_are_passed_are_removed(spark, place):
    drained(spark, place)
    for i in range(4):
        put(place, f"{i}.md", "x", 1000 + i)
        assert drained(spark, place) == [(f"{i}.md", "new", 1)]
    assert len(folders.Manifest(str(place / "listings")).versions()) <= 2


def test_patterns_and_a_missing_folder(spark, place):
    put(place, "a.md", "x", 1000)
    assert folders.listed(str(place / "in"), "*.txt") == {} and len(folders.listed(f"file://{place}/in", "*.md")) == 1
    assert folders.listed(str(place / "none"), "*") == {}
    with pytest.raises(ValueError, match="manifest"):
        folders.FolderReader({"path": "x"})
