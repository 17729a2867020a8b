"""Rows that are counted, back as rows of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 65_536


def numbered(rows: DataFrame, count: str, name: str = "copy") -> DataFrame:
    """Each row as often as its ``count`` says (0: not at all), numbered from 0 in ``name``. A row with more than ``BLOCK``
    copies is dealt out by blocks, each a row that may go to another task, so no array is longer than a block or than
    the number of blocks."""
    zero, n = F.lit(0).cast("long"), F.col(count)
    few = rows.where((n > 0) & (n <= BLOCK)).select("*", F.explode(F.sequence(zero, n - 1)).alias(name))
    blocks = rows.where(n > BLOCK).select("*", F.explode(F.sequence(zero, n - 1, F.lit(BLOCK).cast("long"))).alias("_from")).repartition(count, "_from")
    many = blocks.select(*rows.columns, F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + BLOCK, n) - 1)).alias(name))
    return few.unionByName(many)
