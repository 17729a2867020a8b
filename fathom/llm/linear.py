"""A logistic scorer over hashed features, trained by AdaGrad on a sample bounded in rows and features, inside one task."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.session import cut

MOST_FEATURES = 16_000_000
BATCH = 256  # documents that go to Python at a time


def sigmoid(z: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(
    rows: list[tuple[float, np.ndarray, np.ndarray]], dims: int, epochs: int = 8, rate: float = 0.05, decay: float = 1e-4, values: np.ndarray | None = None
) -> tuple[np.ndarray, float]:
    """Weights and bias from (label in 0..1, distinct indices, values); the order of ``rows`` does not matter. Where a
    feature has the same value in all rows, ``values`` holds it by index and rows need none."""
    w, seen = np.zeros(dims), np.full(dims, 1e-8)
    share = np.clip(np.mean([y for y, _, _ in rows]), 1e-3, 1 - 1e-3) if rows else 0.5
    bias = float(np.log(share / (1 - share)))
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            y, at, x = rows[i]
            x = x if values is None else values[at]
            own = w[at]
            error = sigmoid(bias + own @ x) - y
            slope = error * x + decay * own
            seen[at] += slope * slope
            w[at] = own - rate * slope / np.sqrt(seen[at])
            bias -= 0.01 * error
    return w, bias


def fit_on_one(
    features: DataFrame, dims: int, epochs: int = 8, rate: float = 0.05, most: int = MOST_FEATURES, values: np.ndarray | None = None
) -> tuple[np.ndarray, float]:
    """``features``: key long, y double, at array<int>, x array<float>, of a bounded number of rows. They meet in one
    task, in order of key; the weights (``dims`` at most) come back as rows.

    The sample is bounded in features too: rows are taken in order of a hash of their key up to ``most`` features in
    all, so long texts cannot fill the task (8 bytes a feature)."""
    drawn = F.xxhash64(F.lit("fit"), "key", "y", F.size("at"))
    features = cut(features.withColumn("drawn", drawn), "features")
    sizes = sorted(tuple(r) for r in features.select("drawn", F.size("at")).collect())  # one small row a sampled document
    total = np.cumsum([n for _, n in sizes])
    taken = max(1, int(np.searchsorted(total, most, side="right")))
    chosen = features.where(F.col("drawn") <= sizes[min(taken, len(sizes)) - 1][0]) if sizes else features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            for key, y, at, x in zip(*b.columns, strict=True):
                rows.append((key.as_py(), y.as_py(), at.values.to_numpy().copy(), x.values.to_numpy(zero_copy_only=False).copy()))
        rows.sort(key=lambda r: (r[0], r[1], zlib.crc32(r[2])))  # keys may tie: null and repeated ids
        w, bias = fit([r[1:] for r in rows], dims, epochs, rate, values=values)
        used = np.flatnonzero(w)
        at = np.append(used, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(w[used], bias))], ["at", "w"])

    conf, rows_a_batch = chosen.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(rows_a_batch)
    conf.set(rows_a_batch, min(BATCH, int(before)) if int(before) > 0 else BATCH)  # rows are long here: ten thousand would fill the task
    try:
        found = chosen.drop("drawn").repartition(1).mapInArrow(run, "at int, w double").toPandas()
    finally:
        conf.set(rows_a_batch, before)
    w = np.zeros(dims, np.float32)
    real = found[found["at"] >= 0]
    w[real["at"]] = real["w"]
    bias = found.loc[found["at"] < 0, "w"]
    return w, float(bias.iloc[0]) if len(bias) else 0.0


def featurized(docs: DataFrame, features: Callable[[str], tuple[np.ndarray, np.ndarray]], y: str) -> DataFrame:
    """key, y, at, x of rows with doc_id, text and a label column. ``features`` may give no values (see ``fit``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [features(t.as_py() or "") for t in b.column(2)]
            at = pa.array([a.astype(np.int32) for a, _ in made], pa.list_(pa.int32()))
            x = pa.array([v.astype(np.float32) for _, v in made], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), at, x], ["key", "y", "at", "x"])

    rows = docs.selectExpr("coalesce(cast(doc_id as long), -1) key", f"cast({y} as double) y", "text")
    return rows.mapInArrow(run, "key long, y double, at array<int>, x array<float>")
