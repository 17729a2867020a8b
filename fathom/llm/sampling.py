"""Bounded, reproducible samples of labelled rows, and the held-out fold of the queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 4
HELD_OUT = 2


def is_held_out(doc_id: str = "doc_id") -> Column:
    """False for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def bounded(rows: DataFrame, label: str, most: int, key: str = "doc_id") -> tuple[DataFrame, dict]:
    """About ``most`` rows of each label at most, chosen by a hash of the key, and the counts by label of all rows.

    The counts (one row a label) are all that reaches the driver."""
    counts = {r[0]: r[1] for r in rows.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    grain = 1 << 30
    drawn = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(grain))
    chosen = [(F.col(label) == v) & (drawn < int(grain * min(1.0, most / n))) for v, n in sorted(counts.items(), key=lambda x: str(x[0]))]
    return rows.where(reduce(lambda a, b: a | b, chosen, F.lit(False))), counts


def drawn(rows: DataFrame, label: str, most: int, *, keys: dict[str, Column]) -> DataFrame:
    """About ``most`` distinct rows of each label at most, told apart by ``keys``, which become columns. A row counts once
    however often it occurs, whether or not its id is null; a label with few distinct rows keeps them all.

    Distinct rows are counted by a sketch (one number a label reaches the driver), and only rows that are drawn are
    gathered by key, copies pre-aggregated."""
    keyed = rows.where(F.col(label).isNotNull()).withColumns(keys)
    grain = 1 << 30
    place = F.xxhash64(F.lit("drawn"), *keys)
    counts = {r[0]: r[1] for r in keyed.groupBy(label).agg(F.approx_count_distinct(place)).collect()}
    at = F.pmod(place, F.lit(grain))
    chosen = [(F.col(label) == v) & (at < int(grain * min(1.0, most / max(1, n)))) for v, n in sorted(counts.items(), key=lambda x: str(x[0]))]
    return once(keyed.where(reduce(lambda a, b: a | b, chosen, F.lit(False))), [label, *keys])


def once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each value of the keys. The number of partitions is stated, or adaptive execution would bring a sample
    together in one or two, whose texts and features then fill a single task."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).dropDuplicates(keys)
