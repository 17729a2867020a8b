"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from fathom.session import cut
from fathom.llm import decontaminate, language, line_dedup, minhash, mixing, quality, sharding, simhash, suffix_array, toxicity
from tests.llm.conftest import rows

import corpus_pipeline


def labels(docs):
    return docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")).union(docs.limit(1).select("doc_id", F.lit(None).cast("int")))


def benchmark(docs):
    return docs.where("doc_id = 10 or doc_id is null or doc_id = 300").select(F.col("doc_id").alias("item_id"), "text")


ROW_WISE = {
    "mix": mixing.mix,
    "quality": quality.assess,
    "minhash": minhash.edited,
    "prints": minhash.fingerprints,
    "language": lambda d: language.identify(d, d),
    "lines": line_dedup.deduplicate,
    "toxicity": lambda d: toxicity.score(d, d, labels(d)),
    "simhash": simhash.near_duplicates,
    "shards": sharding.shard,
}


@pytest.mark.parametrize("name", ROW_WISE)
def test_one_row_for_each(docs, nothing, name):
    got = Counter(r.doc_id for r in ROW_WISE[name](docs).select("doc_id").collect())
    assert got == Counter(r[0] for r in rows())
    assert ROW_WISE[name](nothing).count() == 0


FILTERS = {
    "language": lambda d: language.keep_identified(d, d),
    "simhash": simhash.keep_one,
    "leaks": lambda d: decontaminate.without_leaks(d, benchmark(d)),
    "mix": mixing.resample,
}


@pytest.mark.parametrize("name", FILTERS)
def test_columns_stay(docs, nothing, name):
    kept = FILTERS[name](docs)
    assert kept.columns == docs.columns and kept.count() > 0
    assert kept.where("h1 <> 'h1' or row <> 'row' or size <> 'size' or times <> 'times'").count() == 0
    assert FILTERS[name](nothing).count() == 0


def test_empty_benchmark_and_passages(docs, nothing):
    assert decontaminate.leaks(docs, benchmark(nothing)).count() == 0
    assert suffix_array.repeated_passages(nothing).count() == 0


def test_defined_results(docs):
    found = {r.doc_id: r for r in language.identify(docs, docs).collect()}
    assert all(found[i].lang_pred == "und" for i in (300, 301, 302, 303)) and found[304].lang_pred in ("xx", "yy")
    prints = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert prints[300].fp == prints[301].fp == 0 and prints[302].component_id == 300
    assert prints[111].component_id == 100
    sizes = {r.doc_id: r for r in sharding.shard(docs).collect()}
    assert sizes[300]["size"] == 16 and sizes[300].text_crc32 == 0


def test_no_labels_and_no_languages(docs, nothing):
    bare = toxicity.score(docs, docs, labels(docs).where("doc_id < 0"))
    assert {r.score for r in bare.collect()} == {0.5}
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}


def test_pipeline_on_odd_rows(spark, docs, nothing):
    sf_dir = "/root/testdata/sf0.001"
    kept = {r[0] for r in rows()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs, nothing = cut(stage(spark, docs, sf_dir)), cut(stage(spark, nothing, sf_dir))
        assert docs.columns == before.columns == nothing.columns and nothing.isEmpty(), name
        assert docs.where("h1 <> 'h1' or row <> 'row' or size <> 'size' or times <> 'times'").isEmpty()
        found = [r.doc_id for r in docs.select("doc_id").collect()]
        assert found and set(found) <= kept
        if name == "language ID":
            assert not {300, 301, 302, 303} & set(found) and found.count(307) == 2 and {None, 304, 306} <= set(found)
        if name.startswith("SimHash"):
            assert len(found) == len(set(found)) and 100 in found and not set(range(101, 112)) & set(found)
        kept = set(found)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == docs.count() and corpus_pipeline.STAGES[-1][1](spark, nothing, sf_dir).isEmpty()
