"""Snapshots by content: shared parts, refusals, listing."""

import json

import pytest
from pyspark.sql import functions as F

from fathom.operators import snapshots as sn


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "snapshots")


def rows(spark, n=500):
    return spark.range(n).select(F.col("id").alias("k"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("maybe"))


def test_a_changed_part_is_the_only_one_written(spark, folder):
    first, other = rows(spark), rows(spark, 20)
    wrote = sn.store({"a": first, "b": other}, folder, "one", parts=8, created_ms=1000)
    assert wrote == {"a": 8, "b": 8}
    changed = first.withColumn("v", F.when(F.col("k") == 77, "new").otherwise(F.col("v")))
    assert sn.store({"a": changed, "b": other.repartition(3).select("maybe", "k", "v").select("k", "v", "maybe")}, folder, "two", parts=8, created_ms=2000) == {"a": 1, "b": 0}
    assert [(r.label, r.number, r.rows) for r in sn.listing(spark, folder).collect()] == [("two", 1, 520), ("one", 0, 520)]
    old, new = sn.restore(spark, folder, 0)["a"], sn.restore(spark, folder)["a"]
    assert old.exceptAll(first).isEmpty() and first.exceptAll(old).isEmpty() and new.exceptAll(changed).isEmpty() and new.count() == 500
    with pytest.raises(ValueError, match="no such"):
        sn.restore(spark, folder, 7)


def test_empty_and_repeated_rows(spark, folder):
    twice = rows(spark, 5).unionAll(rows(spark, 5))
    sn.store({"none": rows(spark).limit(0), "twice": twice}, folder)
    back = sn.restore(spark, folder)
    assert back["none"].count() == 0 and back["none"].columns == ["k", "v", "maybe"] and back["twice"].count() == 10
    with pytest.raises(ValueError, match="unsafe"):
        sn.store({"../x": twice}, folder)


def spoil(path, how):
    file = next(p for p in path.iterdir() if p.name.startswith("part"))
    manifest = json.loads(file.read_text())
    how(manifest)
    file.write_text(json.dumps(manifest))
    (path / f".{file.name}.crc").unlink(missing_ok=True)


def test_what_is_refused(spark, tmp_path):
    base = tmp_path / "s"
    sn.store({"a": rows(spark, 50)}, str(base), parts=4)
    assert sn.problems(spark, str(base)) == [] and sn.problems(spark, str(base), most_entries=3) == ["4 entries"]
    assert sn.problems(spark, str(base), most_bytes=10)[0].endswith("bytes")
    part = sorted((base / "objects/a").glob("_object=*"))[0]
    held = spark.read.parquet(str(part)).collect()
    # A value changed in place: counts stay equal.
    spark.createDataFrame([(r.k, r.v + "!", r.maybe) for r in held], "k long, v string, maybe long").write.mode("overwrite").parquet(str(part))
    assert sn.problems(spark, str(base)) == ["values of a"]
    spark.createDataFrame([(r.k, r.v) for r in held], "k long, v string").write.mode("overwrite").parquet(str(part))
    assert sn.problems(spark, str(base)) != []
    spark.createDataFrame(held, "k long, v string, maybe long").write.mode("overwrite").parquet(str(part))
    assert sn.problems(spark, str(base)) == []
    manifest = base / "manifests/000000000"
    spoil(manifest, lambda m: m["tables"][0]["schema"]["fields"][0].update(type="string"))
    assert sn.problems(spark, str(base)) == ["schema of a"]
    spoil(manifest, lambda m: (m["tables"][0]["schema"]["fields"][0].update(type="long"), m.update(app="other")))
    assert sn.problems(spark, str(base)) == ["format"]
    spoil(manifest, lambda m: (m.update(app=sn.APP), m["tables"][0].update(name="../etc")))
    assert sn.problems(spark, str(base)) == ["unsafe name ../etc"]
    (manifest / "_SUCCESS").unlink()
    assert sn.listing(spark, str(base)).count() == 0
