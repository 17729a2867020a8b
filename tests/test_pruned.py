"""The pruned search against every distance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import pruned


def clustered(n, dims=8, groups=20, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dims)) * 5
    return (centres[r.integers(groups, size=n)] + r.normal(size=(n, dims)) * 0.3).astype(np.float32)


def rows_of(spark, points, extra=()):
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)] + list(extra)
    return spark.createDataFrame(rows, "doc_id long, embedding array<float>").repartition(5)


def brute(points, queries, k):
    p, q = points.astype(np.float64), queries.astype(np.float64)
    out = set()
    for i, v in enumerate(q):
        d = ((p - v) ** 2).sum(axis=1).round(9)
        out |= {(i, int(j), r + 1) for r, j in enumerate(np.lexsort((np.arange(len(p)), d))[:k])}
    return out


def asked(spark, queries):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(queries)], "query_id long, query_vector array<float>")


def got(top):
    return {(r.query_id, r.doc_id, r.vector_rank) for r in top.collect()}


@pytest.mark.parametrize("piece,block", [(2048, 2048), (16, 3)])
def test_equals_every_distance_and_skips_most(spark, piece, block):
    points = clustered(1500)
    queries = np.concatenate((points[::100], clustered(5, seed=9) + 1))
    index = pruned.built(rows_of(spark, points), clusters=24, piece=piece)
    found = pruned.search(index, asked(spark, queries), 7, block)
    assert got(found.top) == brute(points, queries, 7)
    told = pruned.skipped(index, found).first()
    assert told.n_queries == len(queries) and 0.6 < told.share_skipped < 1
    assert index.pieces.agg(F.max("n")).first()[0] <= piece and index.pieces.agg(F.sum("n")).first()[0] == len(points)


def test_unclustered_points_and_a_hot_group_of_copies(spark):
    r = np.random.default_rng(1)
    points = r.normal(size=(900, 6)).astype(np.float32)
    points[300:700] = points[300]
    queries = points[[300, 5, 899]]
    assert got(pruned.topk(rows_of(spark, points), asked(spark, queries), 10, clusters=12, piece=32)) == brute(points, queries, 10)


def test_pieces_are_even_runs_of_one_cluster(spark):
    points = clustered(700, groups=3)
    index = pruned.built(rows_of(spark, points), clusters=3, piece=50)
    sizes = [r.n for r in index.pieces.collect()]
    assert max(sizes) <= 50 and sum(sizes) == 700 and len(sizes) <= 700 / 50 + 3 + 2 * 4


def test_odd_rows(spark):
    points = clustered(40)
    odd = [(100, None), (101, []), (102, [float("nan")] * 8), (103, [1.0, None] + [1.0] * 6), (104, [1.0, 2.0]), (105, [float("inf")] * 8)]
    queries = asked(spark, points[:2]).union(spark.createDataFrame([(9, None), (10, [1.0])], "query_id long, query_vector array<float>"))
    found = pruned.topk(rows_of(spark, points, odd), queries, 50)
    assert got(found) == brute(points, points[:2], 50)
    empty = rows_of(spark, points).where("doc_id < 0")
    assert pruned.topk(empty, asked(spark, points[:2])).count() == 0
    assert pruned.topk(rows_of(spark, points), asked(spark, points[:2]).where("query_id < 0")).count() == 0
