"""Connected components by alternating star contraction: joins and pre-aggregated minima only, cut once a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.session import cut


SALTS = 8  # parts of a node's links that may go to different tasks


def _with_least(pairs: DataFrame) -> DataFrame:
    """Adds the least of each u and its neighbours. The hub of a large component has many links, so they are salted."""
    least = pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("least"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return salted.join(least, ["u", "salt"]).drop("salt")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    met = _with_least(down)
    return met.select("u", F.col("least").alias("v")).union(met.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` (u long, v long) -> (u, root): the least node that u reaches, for nodes with a link to a lesser node.

    Loops and repeated edges do no harm; an empty table gives an empty one."""
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        edges = cut(_small_star(_large_star(edges)).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select("u", F.col("v").alias("root"))
        seen = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
