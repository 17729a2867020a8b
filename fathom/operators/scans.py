"""Running values along the rows of a key, for keys of any size.

A window puts all rows of a key in one task. Where a key has more than ``MOST_ROWS`` rows, the table is cut by ranges of
(key, order) into pieces instead, each a task of its own. A piece keeps what it needs of the pieces before it as one
summary row by key: the largest value, the sum, or the last row. Windows run within pieces only, and a summary of each
(key, piece) is carried on to the pieces after it. A key that fills every piece adds one summary row for each piece.

Results are the same either way. Rows are told apart by ``order``: rows that tie there have no order between them. Null
keys are one key. Pieces are written to the shared folder, so that a lost executor cannot change where they are cut.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.session import cut

MOST_ROWS = 1_000_000


@dataclass(frozen=True)
class Carry:
    """``kind``: ``max`` (up to and with the row), ``max_before``, ``min``, ``sum_before`` (null before the first value),
    ``last_before`` (of the row before, null or not), ``seen_before`` (the last value before the row that is not null)."""

    kind: str
    value: Column


def _window(keys: list[str], order: list[str], last: int) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)


def _own(c: Carry, keys: list[str], order: list[str]) -> Column:
    """The running value, from the rows of the window's partition alone. ``last_before`` is boxed: null means no row."""
    before = _window(keys, order, -1)
    if c.kind == "last_before":
        return F.lag(F.struct(c.value.alias("v"))).over(Window.partitionBy(*keys).orderBy(*order))
    if c.kind == "seen_before":
        return F.last(c.value, ignorenulls=True).over(before)
    if c.kind == "sum_before":
        return F.sum(c.value).over(before)
    if c.kind == "max_before":
        return F.max(c.value).over(before)
    return {"max": F.max, "min": F.min}[c.kind](c.value).over(_window(keys, order, 0))


def _summary(c: Carry, order: list[str]) -> Column:
    """Of the rows of a piece."""
    place = F.struct(*order)
    if c.kind == "last_before":
        return F.max_by(F.struct(c.value.alias("v")), place)
    if c.kind == "seen_before":
        return F.max_by(c.value, F.when(c.value.isNotNull(), place))
    if c.kind == "sum_before":
        return F.sum(c.value)
    return F.min(c.value) if c.kind == "min" else F.max(c.value)


def _joined(c: Carry, own: Column, carried: Column) -> Column:
    if c.kind in ("last_before", "seen_before"):
        return F.coalesce(own, carried)
    if c.kind == "sum_before":
        return F.when(own.isNull(), carried).otherwise(own + F.coalesce(carried, F.lit(0).cast("long")))
    return F.least(own, carried) if c.kind == "min" else F.greatest(own, carried)


def largest_key(rows: DataFrame, key: str) -> int:
    return rows.groupBy(key).count().agg(F.max("count")).first()[0] or 0


def running(rows: DataFrame, key: str, order: list[str], carries: dict[str, Carry], most_rows: int = MOST_ROWS, largest: int | None = None) -> DataFrame:
    """The rows with one more column for each of ``carries``. ``largest``: rows of the largest key, counted if not given."""
    largest = largest_key(rows, key) if largest is None else largest
    unboxed = lambda n, c, v: (v["v"] if c.kind == "last_before" else v).alias(n)
    if largest <= most_rows:
        made = rows.select("*", *(_own(c, [key], order).alias(f"_{n}") for n, c in carries.items()))
        return made.select(*rows.columns, *(unboxed(n, c, F.col(f"_{n}")) for n, c in carries.items()))
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-largest // most_rows))
    dealt = cut(rows.repartitionByRange(n, key, *order).withColumn("_piece", F.spark_partition_id()), "pieces")
    ends = dealt.groupBy(key, "_piece").agg(*(_summary(c, order).alias(f"s_{n}") for n, c in carries.items()))
    # Of the pieces before, by key: at most one row a piece, of the key that goes on in it.
    onward = {"last_before": F.last, "seen_before": lambda v: F.last(v, ignorenulls=True), "sum_before": F.sum, "min": F.min}
    pieces_before = _window([key], ["_piece"], -1)
    carried = ends.select(F.col(key).alias("_key"), F.col("_piece").alias("_of"), *(onward.get(c.kind, F.max)(F.col(f"s_{n}")).over(pieces_before).alias(f"c_{n}") for n, c in carries.items()), F.count(F.lit(1)).over(pieces_before).alias("_before"))
    carried = cut(carried.where("_before > 0").drop("_before"), "carried")
    own = dealt.select("*", *(_own(c, [key, "_piece"], order).alias(f"_{n}") for n, c in carries.items()))
    met = own.join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_piece") == F.col("_of")), "left")
    return met.select(*rows.columns, *(unboxed(n, c, _joined(c, F.col(f"_{n}"), F.col(f"c_{n}"))) for n, c in carries.items()))
