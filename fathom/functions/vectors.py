"""Vector expressions over array<float>, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def squared_distance(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for null, empty and zero vectors; within -1 and 1."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm))).otherwise(0.0)


def relevance(distance: Column) -> Column:
    """Of a squared distance between unit vectors; 0 for null."""
    return F.when(distance.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - distance / 2.0)))
