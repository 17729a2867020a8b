"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Entries become integers (floor of ``SCALE`` times the entry), so that all sums are exact and no order of tasks changes
them. Each distinct vector counts once. Vectors are centred by the rounded mean before they are multiplied; the
rest of the mean, below a half in each dimension, is taken off the summed scatter in exact integers. The factor of the
covariance is rotated column by column until all its columns are orthogonal: their squared norms are the eigenvalues
and the columns, brought to length one, the components, so the covariance itself is never diagonalised.

Tasks return sums by dimension and by pair of dimensions; ``MOST_DIMS`` bounds what reaches the driver. Rows are then
projected where they lie.

Defined cases: rows whose vector is null or holds a null or non-finite entry are left out; shorter vectors end in
zeros up to the longest; scaled entries beyond 2^53 count as 2^53; components without variance are not returned, so
equal vectors alone, a single vector or an empty table give no rows; a deviation beyond 38 digits is null; null and
repeated keys are rows like others; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.session import cut

SCALE = 256
MOST_DIMS = 2048
_EXACT = pa.decimal128(38, 0)
_WIDEST = 1 << 53  # the largest integer up to which doubles hold every one


@dataclass
class Fit:
    n: int
    centre: np.ndarray  # integers, the rounded means
    rest: list[int]  # by dimension: sum of the centred entries, exact
    components: np.ndarray  # dimensions x k
    values: np.ndarray  # eigenvalues of the k components
    trace: float
    identity_error: float = 0.0

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        left = np.array([r / self.n for r in self.rest])
        return (centred - left) @ self.components / np.sqrt(self.values)

    def deviations(self, centred: np.ndarray) -> list[int]:
        """Squared length of n * x - S, exact: with y = x - centre it is n^2 y.y - 2 n y.rest + rest.rest."""
        most = int(np.abs(centred).max(initial=0)) + 1
        wide = most * max(most, *map(abs, self.rest), 1) * centred.shape[1] >= 1 << 62
        y = centred.astype(object) if wide else centred
        squares, cross = (y * y).sum(axis=1), y @ np.array(self.rest, object if wide else np.int64)
        own = sum(r * r for r in self.rest)
        return [self.n * self.n * int(s) - 2 * self.n * int(c) + own for s, c in zip(squares, cross, strict=True)]


def cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower triangular factor (dimensions in the order of ``pivots``, one column for each of the rank) and pivots."""
    a, d = a.astype(float).copy(), len(a)
    pivots, factor = np.arange(d), np.zeros((d, d))
    least = d * np.finfo(float).eps * max(np.diag(a).max(initial=0.0), 0.0)
    for k in range(d):
        left = np.diag(a)[pivots[k:]] - (factor[k:, :k] ** 2).sum(axis=1)
        best = k + int(np.argmax(left))
        if left[best - k] <= least:
            return factor[:, :k], pivots
        pivots[[k, best]], factor[[k, best]] = pivots[[best, k]], factor[[best, k]]
        factor[k, k] = np.sqrt(left[best - k])
        below = a[pivots[k + 1 :], pivots[k]] - factor[k + 1 :, :k] @ factor[k, :k]
        factor[k + 1 :, k] = below / factor[k, k]
    return factor, pivots


def rotated(factor: np.ndarray, most_sweeps: int = 60) -> np.ndarray:
    """The factor after one-sided Jacobi rotations of pairs of columns, all orthogonal. A round turns disjoint pairs at
    once; a sweep of rounds meets every pair."""
    g, r = factor.copy(), factor.shape[1]
    ring = np.arange(r + r % 2)  # with a bye if the number is odd
    for _ in range(most_sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            p, q = ring[: len(ring) // 2], ring[::-1][: len(ring) // 2]
            met = (p < r) & (q < r)
            p, q = p[met], q[met]
            x, y = g[:, p], g[:, q]
            a, b, c = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            open_ = np.abs(c) > 1e-15 * np.sqrt(a * b)
            if open_.any():
                turned = True
                x, y, a, b, c, p, q = x[:, open_], y[:, open_], a[open_], b[open_], c[open_], p[open_], q[open_]
                zeta = (b - a) / (2 * c)
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                cos = 1 / np.hypot(1.0, t)
                g[:, p], g[:, q] = cos * x - cos * t * y, cos * t * x + cos * y
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if not turned:
            break
    return g


def eigen(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues that are not zero, falling, and their unit vectors as columns; the entry of a vector
    that is largest in size is positive."""
    factor, pivots = cholesky(covariance)
    g = rotated(factor)
    norms = np.sqrt((g * g).sum(axis=0))
    order = np.argsort(-norms, kind="stable")[:k]
    order = order[norms[order] > len(covariance) * np.finfo(float).eps * norms.max(initial=0.0)]
    vectors = np.zeros((len(covariance), len(order)))
    vectors[pivots] = g[:, order] / norms[order]
    return norms[order] ** 2, vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)


def scatter(y: np.ndarray) -> np.ndarray:
    """Exact y'y of integers: in doubles, block by block, while all sums stay below 2^53, else in whole numbers."""
    most = int(np.abs(y).max(initial=0)) ** 2
    if most >= 1 << 46:
        return y.astype(object).T @ y.astype(object)
    step, total = max(1, (_WIDEST - 1) // max(1, most)), 0
    for at in range(0, len(y), step):
        block = y[at : at + step].astype(float)
        total = total + (block.T @ block).astype(np.int64).astype(object)
    return total


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _exact(values: list[int]) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], _EXACT)


def _sums(dims: int) -> Callable:
    """Sums by dimension of one task; dimension -1 counts the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, object)
        for b in batches:
            x = _matrix(b.column(0), dims)
            n, total = n + len(x), total + (x >> 20).sum(axis=0).astype(object) * (1 << 20) + (x & 0xFFFFF).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(dims)], pa.int32()), _exact([n, *total])], ["i", "s"])

    return run


def _scatters(centre: np.ndarray) -> Callable:
    """Sums by pair of dimensions of one task."""
    dims = len(centre)
    i, j = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims), object)
        for b in batches:
            total = total + scatter(_matrix(b.column(0), dims) - centre)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), _exact(total[i, j])], ["i", "j", "s"])

    return run


def _moments(found: Fit) -> Callable:
    """Sums of the whitened entries (j = -1) and of their products, of one task."""
    k = len(found.values)
    i, j = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for b in batches:
            w = found.whitened(_matrix(b.column(0), len(found.centre)) - found.centre)
            first, second = first + w.sum(axis=0), second + w.T @ w
        at = [np.concatenate([np.arange(k), i]), np.concatenate([np.full(k, -1), j]), np.concatenate([first, second[i, j]])]
        yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(at[2])], ["i", "j", "s"])

    return run


def scaled(vectors: DataFrame, column: str, key: str) -> DataFrame:
    """key and x, the integers of the usable rows, all of one length (``_dims``)."""
    finite = F.forall(column, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))), F.lit(False)))
    whole = lambda e: F.greatest(F.lit(-_WIDEST), F.least(F.lit(_WIDEST), F.floor(e.cast("double") * SCALE)))
    return vectors.where(F.col(column).isNotNull() & finite).select(F.col(key).alias("key"), F.transform(column, whole).alias("x"))


def _filled(rows: DataFrame, dims: int) -> DataFrame:
    return rows.withColumn("x", F.when(F.size("x") < dims, F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x")))).otherwise(F.col("x")))


def fit(rows: DataFrame, dims: int, k: int) -> Fit | None:
    """Of the distinct vectors x, all of length ``dims``; None if there is no variance."""
    vectors = cut(rows.select("x").distinct(), "vectors")
    sums = {r.i: int(r.s) for r in vectors.mapInArrow(_sums(dims), "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    n = sums.get(-1, 0)
    if not n:
        return None
    centre = [(2 * sums[i] + n) // (2 * n) for i in range(dims)]
    rest = [sums[i] - n * c for i, c in enumerate(centre)]
    told = vectors.mapInArrow(_scatters(np.array(centre, np.int64)), "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s"))
    covariance = np.zeros((dims, dims))
    for i, j, s in told.collect():
        covariance[i, j] = covariance[j, i] = (n * int(s) - rest[i] * rest[j]) / (n * n)
    values, components = eigen(covariance, k)
    if not len(values):
        return None
    found = Fit(n, np.array(centre, np.int64), rest, components, values, float(np.trace(covariance)))
    moments = {(r.i, r.j): r.s / n for r in vectors.mapInArrow(_moments(found), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
    found.identity_error = max(abs(m - moments[i, -1] * moments[j, -1] - (i == j)) for (i, j), m in moments.items() if j >= 0)
    return found


def whiten(vectors: DataFrame, k: int = 4, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key, component (from 1), n (distinct vectors), deviation decimal(38,0), whitened, explained, identity_error: a
    row for each usable row and component, up to ``k``."""
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = scaled(vectors, column, key)
    dims = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if dims > MOST_DIMS:
        raise ValueError(f"vectors of {dims} entries; at most {MOST_DIMS} can be whitened")
    rows = _filled(rows, dims)
    found = fit(rows, dims, k) if dims else None
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)
    shared = vectors.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        parts = len(f.values)
        for b in batches:
            y = _matrix(b.column(1), dims) - f.centre
            m = len(y)
            far = pa.array([Decimal(v) if v < 10**38 else None for v in f.deviations(y)], _EXACT)
            spread = pa.array(np.repeat(np.arange(m), parts))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(spread),
                    pa.array(np.tile(np.arange(1, parts + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * parts, f.n)),
                    far.take(spread),
                    pa.array(f.whitened(y).ravel()),
                    pa.array(np.tile(f.values / f.trace, m)),
                    pa.array(np.full(m * parts, f.identity_error)),
                ],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
