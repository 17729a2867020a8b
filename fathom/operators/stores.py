"""Durable rows by owner: tables partitioned by a hash of the owner, changed a few partitions at a time.

A change reads the partitions (buckets) of its owners, makes their new rows and writes those partitions with dynamic
overwrite: the new files are staged first and the old ones give way when the job commits, so a write that dies leaves
the old rows. Each bucket holds one mark besides its rows: the number of the last batch applied to it. The mark is written
with the rows, so a batch that is replayed, in whole or after it died half-way, finds the buckets it has already changed
and leaves them as they are. An emptied bucket is written too, as its mark alone.

Batches must come in rising order (as those of a stream do); a change without a number is always applied. A bucket is
split over tasks by size (a rebalance hint), so an owner with very many rows does not make one large file.

Defined cases: a null owner is an owner; owners without rows are no error; an empty change changes nothing; columns that the
stored rows lack come in as null, and the other way round; columns named ``bucket``, ``_mark`` and ``_batch`` are not allowed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.session import cut

RESERVED = ("bucket", "_mark", "_batch")
Change = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Store:
    path: str
    owner: str
    schema: T.StructType
    buckets: int = 64

    def __post_init__(self) -> None:
        if clash := set(RESERVED) & set(self.schema.names):
            raise ValueError(f"reserved column names: {sorted(clash)}")

    def _all(self, spark: SparkSession) -> DataFrame:
        fields = [T.StructField(f.name, f.dataType, True) for f in self.schema]
        schema = T.StructType([*fields, T.StructField("_mark", T.BooleanType()), T.StructField("_batch", T.LongType()), T.StructField("bucket", T.IntegerType())])
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(self.path)

    def rows(self, spark: SparkSession) -> DataFrame:
        return self._all(spark).where(~F.col("_mark")).select(*self.schema.names)

    def batches(self, spark: SparkSession) -> DataFrame:
        """bucket, batch: the ledger, one row for each bucket that was ever written."""
        return self._all(spark).where("_mark").select("bucket", F.col("_batch").alias("batch"))

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.owner), F.lit(self.buckets)).cast("int")

    def change(self, changes: DataFrame, how: Change, batch: int | None = None) -> list[int]:
        """Apply ``how(current rows of the owners' buckets, changes)`` and return the buckets written. ``changes`` has the
        owner column; rows of other owners in a bucket must come back from ``how`` as they are."""
        spark = changes.sparkSession
        held = cut(changes.withColumn("bucket", self.bucket()), "changes")  # the same rows for every step below
        touched = [r.bucket for r in held.select("bucket").distinct().collect()]  # ``buckets`` rows at most
        before = self._all(spark).where(F.col("bucket").isin(touched))
        marks = {r.bucket: r["_batch"] for r in before.where("_mark").collect()} if touched else {}
        open_ = [b for b in touched if batch is None or marks.get(b) is None or marks[b] < batch]
        if not open_:
            return []
        mine = F.col("bucket").isin(open_)
        current = before.where(mine & ~F.col("_mark")).select(*self.schema.names)
        made = self._shaped(how(current, held.where(mine).drop("bucket")))
        number = {b: marks.get(b) if batch is None else batch for b in open_}
        marked = spark.createDataFrame([(b, number[b]) for b in open_], "bucket int, _batch long").withColumn("_mark", F.lit(True))
        kept = made.withColumns({"bucket": self.bucket(), "_mark": F.lit(False), "_batch": F.lit(None).cast("long")})
        out = kept.unionByName(marked, allowMissingColumns=True).hint("rebalance", "bucket")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        return open_

    def _shaped(self, rows: DataFrame) -> DataFrame:
        return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema))

    def replace(self, new: DataFrame, owners: DataFrame | None = None, batch: int | None = None) -> list[int]:
        """All rows of the owners in ``new``, and of those named in ``owners``, give way to the new ones."""
        named = new.select(self.owner) if owners is None else owners.select(self.owner).unionByName(new.select(self.owner))
        told = self._shaped(new).withColumn("_new", F.lit(True)).unionByName(named.distinct().withColumn("_new", F.lit(False)), allowMissingColumns=True)

        def how(current: DataFrame, changes: DataFrame) -> DataFrame:
            gone = changes.select(F.col(self.owner).alias("_gone")).distinct()
            kept = current.join(gone, F.col(self.owner).eqNullSafe(F.col("_gone")), "left_anti")
            return kept.unionByName(changes.where("_new").drop("_new"))

        return self.change(told, how, batch)

    def delete(self, owners: DataFrame, batch: int | None = None) -> list[int]:
        return self.replace(self.rows(owners.sparkSession).limit(0), owners, batch)

    def move(self, moves: DataFrame, column: str, batch: int | None = None) -> list[int]:
        """``column`` of the rows of each owner in ``moves`` (owner, to; one row an owner) takes the new value."""

        def how(current: DataFrame, changes: DataFrame) -> DataFrame:
            to = changes.select(F.col(self.owner).alias("_owner"), F.col("to").alias("_to"), F.lit(True).alias("_moved"))
            met = current.join(to, F.col(self.owner).eqNullSafe(F.col("_owner")), "left")
            return met.withColumn(column, F.when(F.col("_moved"), F.col("_to")).otherwise(F.col(column))).drop("_owner", "_to", "_moved")

        return self.change(moves, how, batch)


def sink(store: Store, how: Change) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each micro-batch is applied once, however often it is run."""
    return lambda rows, batch: store.change(rows, how, batch) and None
