"""Exact nearest vectors that read only the parts of the corpus a query can need.

The corpus is dealt to seeded clusters, and each cluster, ordered by the distance to its centre, is cut into pieces of at
most ``PIECE`` rows. A piece knows its nearest and farthest such distance, so by the triangle inequality no vector of it
is nearer to a query than ``away - farthest`` or ``nearest - away``, ``away`` being the query's distance to the centre.
A query first looks into one piece of each of its nearest clusters, which bounds its k-th distance, and then into exactly
those further pieces whose bound is not above that.

A cluster may hold any share of the rows, equal vectors included: its pieces are cut by ranges of (cluster, distance, id).
What reaches the driver is bounded: the sample the centres are fitted on, and one summary a cluster.

Defined cases: vectors that are null, hold null or non-finite entries, or have another length than most of the corpus
have no distances and take no part; equal distances (to 9 digits) rank by id; a corpus of fewer than k rows is returned
whole for every query; an empty corpus or no queries give no rows; columns other than id and vector are not read. Ids of the corpus are long
and unique, so are those of the queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.operators.retrieval import CANDIDATES, QUERY_BLOCK, matrix_of, nearest_batches
from fathom.session import cut

CLUSTERS = 256
SAMPLE = 16 * CLUSTERS  # rows the centres are fitted on
ROUNDS = 6
PIECE = 2048
SLACK = 1e-8  # of squared distances, which are compared as rounded to 9 digits


@dataclass(frozen=True)
class Index:
    """``rows`` (piece, id, vector), ``pieces`` (cluster, piece, nearest, farthest, n), and by cluster the centre, the
    farthest distance and the number of rows."""

    rows: DataFrame
    pieces: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    held: np.ndarray


def _sound(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    made = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return made.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & F.coalesce(finite, F.lit(False)))


def _away(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = (points * points).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2 * points @ centres.T
    return np.sqrt(np.maximum(squares, 0.0))


def fitted_centres(sample: np.ndarray, clusters: int, rounds: int = ROUNDS) -> np.ndarray:
    """Seeded by the first distinct rows of the sample, moved to the means of what is nearest to them."""
    _, first = np.unique(sample, axis=0, return_index=True)
    distinct = sample[np.sort(first)]
    centres = distinct[:clusters].copy()
    for _ in range(rounds if len(distinct) > clusters else 0):
        nearest = _away(distinct, centres).argmin(axis=1)
        for c in range(len(centres)):
            members = distinct[nearest == c]
            if len(members):
                centres[c] = members.mean(axis=0)
    return centres


def _assigned(centres: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, PIECE) for i in range(0, len(whole), PIECE)):
                points = matrix_of(b.column(1))
                nearest = _away(points, centres).argmin(axis=1)
                gap = np.linalg.norm(points - centres[nearest], axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nearest.astype(np.int32)), pa.array(gap)], ["id", "vector", "cluster", "gap"])

    return run


def _cut_in_pieces(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Numbers runs of at most ``size`` rows of one cluster; rows come sorted by cluster and distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, cluster, filled = (TaskContext.get().partitionId() << 32) - 1, None, 0
        for b in batches:
            names = b.column(2).to_numpy()
            edges = np.concatenate(([0], np.flatnonzero(names[1:] != names[:-1]) + 1, [len(names)])) if len(names) else []
            out = np.empty(len(names), np.int64)
            for start, stop in zip(edges[:-1], edges[1:], strict=True):
                if names[start] != cluster:
                    piece, cluster, filled = piece + 1, names[start], 0
                steps = (filled + np.arange(stop - start)) // size - (max(filled - 1, 0)) // size
                out[start:stop] = piece + steps
                piece, filled = int(out[stop - 1]), filled + stop - start
            yield pa.RecordBatch.from_arrays([pa.array(out), *b.columns], ["piece", *b.schema.names])

    return run


def built(corpus: DataFrame, clusters: int = CLUSTERS, piece: int = PIECE) -> Index | None:
    """The index of ``corpus`` (doc_id, embedding), written to the shared folder; None if no vector is sound."""
    spark = corpus.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sound = _sound(corpus, "doc_id", "embedding")
    usual = sound.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").first()
    if usual is None:
        return None
    sound = sound.where(F.size("vector") == usual["length"])
    sample = sound.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()
    centres = fitted_centres(np.array([r.vector for r in sample], dtype=np.float64), clusters)
    dealt = cut(sound.mapInArrow(_assigned(centres), "id long, vector array<double>, cluster int, gap double"), "assigned")
    ranged = dealt.repartitionByRange(parts, "cluster", "gap", "id").sortWithinPartitions("cluster", "gap", "id")
    rows = cut(ranged.mapInArrow(_cut_in_pieces(piece), "piece long, id long, vector array<double>, cluster int, gap double"), "vectors")
    pieces = cut(rows.groupBy("piece", "cluster").agg(F.min("gap").alias("nearest"), F.max("gap").alias("farthest"), F.count(F.lit(1)).alias("n")), "pieces")
    radius, held = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in pieces.groupBy("cluster").agg(F.max("farthest").alias("farthest"), F.sum("n").alias("n")).collect():
        radius[r.cluster], held[r.cluster] = r.farthest, r.n
    return Index(rows.select("piece", "id", "vector"), pieces, centres, radius, held)


def _looks(index: Index, k: int, first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (id, vector[, reach]): the clusters a query looks into. First those nearest that hold k rows, with ``reach`` set to a
    bound of the k-th squared distance that holds whatever lies in the clusters; then all within the given reach."""
    centres, radius, held = index.centres, index.radius, index.held
    alive = np.flatnonzero(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, PIECE) for i in range(0, len(whole), PIECE)):
                ids, points = b.column(0).to_numpy(), matrix_of(b.column(1))
                away = _away(points, centres)
                if first:
                    near = alive[np.argsort(away[:, alive], axis=1, kind="stable")]
                    enough = (np.cumsum(held[near], axis=1) - held[near] < k)
                    far = np.take_along_axis(away + radius[None, :], near, axis=1)
                    reach = np.where(enough, far, 0.0).max(axis=1) ** 2 if held.sum() >= k else np.full(len(ids), np.inf)
                    who, at = np.nonzero(enough)
                    cluster = near[who, at]
                else:
                    reach = b.column(2).to_numpy()
                    lower = np.maximum(away - radius[None, :], 0.0) ** 2
                    slack = SLACK * (1 + (points * points).sum(axis=1) + np.where(np.isinf(reach), 0, reach))
                    who, cluster = np.nonzero((lower <= (reach + slack)[:, None]) & (held > 0)[None, :])
                norm = (points * points).sum(axis=1)
                columns = [ids[who], cluster.astype(np.int32), away[who, cluster], reach[who], norm[who]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "cluster", "away", "reach", "norm"])

    return run


_LOOK = "query_id long, cluster int, away double, reach double, norm double"


def _read(index: Index, wanted: DataFrame, visits: DataFrame, k: int, block: int) -> DataFrame:
    """The best k of each visit (query_id, piece). The queries of a piece are dealt into blocks of about ``block``, and
    only then does the piece pass by more than once."""
    parts = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = visits.groupBy("piece").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = visits.join(asked, "piece").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int"))
    held = dealt.join(wanted, F.col("query_id") == F.col("id")).select("block", F.col("piece").alias("part"), F.lit(0).alias("passing"), "id", "vector")
    every = asked.select("piece", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    passing = index.rows.join(every, "piece").select("block", F.col("piece").alias("part"), F.lit(1).alias("passing"), "id", "vector")
    units = held.union(passing).repartition(16 * parts, "block", "part").sortWithinPartitions("block", "part", "passing")
    return units.mapInArrow(nearest_batches(k), "query_id long, doc_id long, distance double")


@dataclass(frozen=True)
class Found:
    """``top``: query_id, doc_id, distance, vector_rank. ``visits``: query_id, piece, one row for each piece read."""

    top: DataFrame
    visits: DataFrame


def search(index: Index, queries: DataFrame, k: int = CANDIDATES, block: int = QUERY_BLOCK) -> Found:
    """The k nearest rows of the index to each of ``queries`` (query_id, query_vector), by squared distance."""
    wanted = cut(_sound(queries, "query_id", "query_vector").where(F.size("vector") == index.centres.shape[1]), "queries")
    lower = F.greatest(F.col("away") - F.col("farthest"), F.col("nearest") - F.col("away"), F.lit(0.0))
    near = cut(wanted.mapInArrow(_looks(index, k, True), _LOOK), "near")
    opened = near.join(index.pieces, "cluster").groupBy("query_id", "cluster").agg(F.min_by("piece", F.struct(lower, "piece")).alias("piece"))
    first_visits = cut(opened.select("query_id", "piece"), "visits")
    begun = cut(_read(index, wanted, first_visits, k, block), "begun")
    kth = begun.groupBy("query_id").agg(F.get(F.array_sort(F.collect_list("distance")), F.lit(k - 1)).alias("kth"))
    bound = near.groupBy("query_id").agg(F.min("reach").alias("bound")).join(kth, "query_id", "left")
    reached = wanted.join(bound, F.col("id") == F.col("query_id")).select("id", "vector", F.least("bound", F.when(F.col("kth").isNotNull(), F.greatest("kth", F.lit(0.0)))).alias("reach"))
    looks = reached.mapInArrow(_looks(index, k, False), _LOOK)
    slack = SLACK * (1 + F.col("norm") + F.when(F.col("reach") < F.lit(float("inf")), F.col("reach")).otherwise(0.0))
    within = looks.join(index.pieces, "cluster").where(lower * lower <= F.col("reach") + slack).select("query_id", "piece")
    further = cut(within.join(first_visits, ["query_id", "piece"], "left_anti"), "visits")
    partial = begun.union(_read(index, wanted, further, k, block))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 9), "doc_id"))
    top = partial.withColumn("vector_rank", rank.cast("long")).where(F.col("vector_rank") <= k)
    return Found(top, first_visits.union(further))


def topk(corpus: DataFrame, queries: DataFrame, k: int = CANDIDATES, clusters: int = CLUSTERS, piece: int = PIECE, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, doc_id, distance, vector_rank: exact, by an index made for this call."""
    index = built(corpus, clusters, piece)
    if index is None:
        return corpus.sparkSession.createDataFrame([], "query_id long, doc_id long, distance double, vector_rank long")
    return search(index, queries, k, block).top


def skipped(index: Index, found: Found) -> DataFrame:
    """One row: n_queries, n_units (pieces times queries), n_read, and the share of rows that no query had to meet."""
    sizes = index.pieces.agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("n").alias("n_rows"))
    read = found.visits.join(index.pieces.select("piece", "n"), "piece").agg(F.count_distinct("query_id").alias("n_queries"), F.count(F.lit(1)).alias("n_read"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_read"))
    units = F.col("n_pieces") * F.col("n_queries")
    share = F.when(F.col("n_queries") > 0, 1 - F.col("rows_read") / (F.col("n_rows") * F.col("n_queries")))
    return sizes.join(read, F.lit(True)).select("n_queries", units.alias("n_units"), "n_read", share.alias("share_skipped"))  # one row each
