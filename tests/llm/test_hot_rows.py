"""Samples and copies where ids are null or equal and one row is most of the table."""

import pytest
from pyspark.sql import functions as F

from fathom.llm import copies, language, linear, mixing, sharding, toxicity
from fathom.llm.sampling import drawn

WORDS = {"en": "the of and with from that this", "fr": "le la de que dans pour une", "xx": "zu ka mi po ra te lo"}


def spoken(spark, n, doc_id="cast(null as long)"):
    """n texts of each language, all distinct."""
    rows = [(lang, f"{words} {i} {words.split()[i % 7]} {words.split()[i // 7 % 7]} {'ab'[i % 2] * (i % 50)}") for lang, words in WORDS.items() for i in range(n)]
    return spark.createDataFrame(rows, "lang string, text string").withColumn("n", F.monotonically_increasing_id()).selectExpr(f"{doc_id} doc_id", "text", "lang")


@pytest.mark.parametrize("doc_id", ["cast(null as long)", "7", "n % 20", "n"])
def test_language_is_learned_whatever_the_ids(spark, doc_id):
    docs = spoken(spark, 700, doc_id)
    model = language.train(docs, per_language=300)
    assert sorted(model.languages) == ["en", "fr", "xx"]
    assert language.keep_identified(docs, docs).count() >= 0.98 * docs.count()


def test_samples_are_bounded_and_count_rows_once(spark):
    keys = {"k": F.col("doc_id"), "h": F.xxhash64("text")}
    many = spoken(spark, 3000, "n % 20")
    assert drawn(many, "lang", 500, keys=keys).groupBy("lang").count().where("count > 600 or count < 400").isEmpty()
    one = spark.createDataFrame([(None, "same", "en")] * 5000 + [(1, "other", "fr")], "doc_id long, text string, lang string")
    assert sorted(r.lang for r in drawn(one, "lang", 100, keys=keys).collect()) == ["en", "fr"]
    assert drawn(one.limit(0), "lang", 100, keys=keys).count() == 0


def test_toxicity_sample_is_bounded_under_few_ids(spark, monkeypatch):
    docs = spoken(spark, 2000, "n % 20")
    labels = docs.select("doc_id").distinct().withColumn("toxic", (F.col("doc_id") % 2).cast("int"))
    fitted = []
    monkeypatch.setattr(linear, "fit_on_one", lambda rows, dims, values: (fitted.append(rows.count()), (__import__("numpy").zeros(dims), 0.0))[1])
    toxicity.train(docs, labels, most=600)
    assert 450 <= fitted[0] <= 750


def test_copies_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(copies, "BLOCK", 100)
    rows = spark.createDataFrame([("a", 0), ("b", 1), ("c", 100), ("d", 1001)], "x string, n long")
    got = sorted((r.x, r["copy"]) for r in copies.numbered(rows, "n").collect())
    assert got == [(x, i) for x, n in (("b", 1), ("c", 100), ("d", 1001)) for i in range(n)]


def test_a_million_equal_rows(spark):
    docs = spark.range(1_000_000).selectExpr("cast(null as long) doc_id", "'the same few words' text", "'s' source")
    others = spark.range(2000).selectExpr("id doc_id", "concat('text ', id) text", "if(id % 2 = 0, 's', 't') source")
    both = docs.union(others)
    shards = sharding.shard(both, n_shards=8)
    loads = [r["sum(size)"] for r in shards.groupBy("shard").sum("size").collect()]
    assert shards.count() == 1_002_000 and max(loads) < 1.02 * min(loads)
    assert shards.groupBy("shard", "slot").count().where("count > 1").isEmpty()
    mixed = mixing.mix(both)
    sums = mixed.groupBy("key").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max(F.col("taken") / F.col("size")).alias("most"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in sums) == 1_002_000 and all(abs(r.taken - r.target) <= 1 and r.most <= 3 for r in sums)


def test_too_many_sources_are_refused_before_they_are_collected(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SUMS", 10)
    with pytest.raises(ValueError, match="more than 10 sources"):
        mixing.mix(spark.range(50).selectExpr("id doc_id", "'a b' text", "cast(id as string) source"))
