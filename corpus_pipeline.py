"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
Every stage works on all rows its predecessor kept.

Defined cases: null and empty texts, and texts without a letter, leave with the first stage; null ids are ids like any
other, sorted last; of rows with equal id and text the near-dedup stage keeps one, and of equal texts the least id;
an empty table stays empty through all stages, with its columns; extra columns, also those named like columns the
operators use inside, pass unchanged through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import decontaminate, language, mixing, sharding, simhash
from fathom.session import cut, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is not certain: no letters, or two languages as likely."""
    return language.keep_identified(docs, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group."""
    return simhash.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark items, re-parameterised ones included."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that the sources have their target weights."""
    return mixing.resample(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size and place of every row of the mix."""
    return sharding.shard(docs, n_shards=40)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate_benchmark),
    ("mixing sources to target weights", mix_sources),
    ("sharding", assign_shards),
]

ORACLE_SQL = None  # learned language models, a flow and a slot map: tested against brute force instead


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and reread as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
