"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct hashed 5- and 6-grams of the whole lower-cased text (a run of anything but letters counts
as blanks). A feature's value is its log ratio of document counts between toxic and other documents, drawn towards
zero by its standard error, so n-grams that chance could explain drop out; a logistic model is trained on those.

Learning uses a sample of about ``TRAIN_DOCS`` labelled documents, distinct in id or text. Counts are summed by Spark by n-gram bucket
(``BUCKETS`` rows reach the driver at most) and the sample's features meet in one task.

Defined cases: a null text is empty; empty texts score the bias (near the share of toxic labels); several labels of a
document count as toxic if one is; null labels are no labels; without labels of both kinds every score is the
smoothed share; repeated rows score alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import linear
from fathom.llm.sampling import drawn, once
from fathom.session import cut

TRAIN_DOCS = 12_000
BUCKETS = 1 << 18
SIZES = (5, 6)
LEAST = 5  # documents that must hold an n-gram
ERRORS = 1.5  # standard errors by which a ratio is drawn towards zero
_BLOCK = 1 << 20


def grams(text: str, wanted: np.ndarray | None = None) -> np.ndarray:
    """Distinct buckets of the n-grams, those with ``wanted`` only if given."""
    codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where((codes < 128) & ((codes < 97) | (codes > 122)), np.uint32(32), codes)
    found = []
    for at in range(0, len(codes), _BLOCK):
        c = codes[at : at + _BLOCK + max(SIZES) - 1]
        for n in SIZES:
            if len(c) >= n:
                h = np.zeros(len(c) - n + 1, np.uint32)
                for k in range(n):
                    h = (h * np.uint32(0x01000193)) ^ c[k : len(c) - n + 1 + k]
                h = (h * np.uint32(0x9E3779B1) + np.uint32(n)) >> np.uint32(14)
                found.append(np.unique(h if wanted is None else h[wanted[h]]))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint32)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BUCKETS), np.int64)
    for b in batches:
        for text, toxic in zip(b.column(0), b.column(1), strict=True):
            counts[int(toxic.as_py() > 0), grams(text.as_py() or "")] += 1
    used = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[0, used]), pa.array(counts[1, used])], ["bucket", "clean", "toxic"])


@dataclass
class Model:
    weights: np.ndarray  # by bucket, log-count ratio included
    bias: float

    def __post_init__(self) -> None:
        self.wanted = self.weights != 0

    def score(self, text: str | None) -> float:
        return linear.sigmoid(self.bias + float(self.weights[grams(text or "", self.wanted)].sum()))


def ratios(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    r = np.log((toxic + 1) / (n_toxic + 2)) - np.log((clean + 1) / (n_clean + 2))
    error = np.sqrt(1 / (toxic + 1) + 1 / (clean + 1))
    r = np.sign(r) * np.maximum(0, np.abs(r) - ERRORS * error)
    r[clean + toxic < LEAST] = 0
    return r


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """``docs`` (doc_id, text) may be learned from; ``labels``: doc_id, toxic."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    marked = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("marked_id")).agg(F.max("toxic").alias("toxic"))
    # Ids and hashes are drawn first, so that of the texts only those in the sample are moved; each (id, text) counts once.
    usable = docs.select("doc_id", "text_hash").join(marked, F.col("doc_id") == F.col("marked_id")).withColumn("all", F.lit(1))
    chosen = drawn(usable, "all", most, keys={"chosen_id": F.col("doc_id"), "chosen_hash": F.col("text_hash")})
    chosen = F.broadcast(chosen.select("chosen_id", "chosen_hash", "toxic"))  # about ``most`` rows
    met = docs.join(chosen, (F.col("doc_id") == F.col("chosen_id")) & (F.col("text_hash") == F.col("chosen_hash")))
    sample = cut(once(met, ["doc_id", "text_hash"]).select("doc_id", "text", "toxic"), "sample")
    n_clean, n_toxic = sample.agg(F.count_if(F.col("toxic") <= 0), F.count_if(F.col("toxic") > 0)).first()
    if not n_clean or not n_toxic:
        share = (n_toxic + 0.5) / (n_clean + n_toxic + 1)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    counted = sample.select("text", "toxic").mapInArrow(_count_batches, "bucket int, clean long, toxic long")
    counted = counted.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("clean") + F.col("toxic") >= LEAST).toPandas()
    clean, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    clean[counted["bucket"]], toxic[counted["bucket"]] = counted["clean"], counted["toxic"]
    scale = ratios(clean, toxic, n_clean, n_toxic).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(scale)

    def features(text: str) -> tuple[np.ndarray, np.ndarray]:
        return grams(text, shared.value != 0), np.empty(0, np.float32)  # values hang on the bucket alone

    labelled = sample.withColumn("y", F.when(F.col("toxic") > 0, 1.0).otherwise(0.0))
    w, bias = linear.fit_on_one(linear.featurized(labelled, features, "y"), BUCKETS, values=scale)
    return Model((w * scale).astype(np.float32), bias)


def score(docs: DataFrame, learn_from: DataFrame, labels: DataFrame, cutoff: float = 0.3) -> DataFrame:
    """doc_id, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(train(learn_from, labels))

    @F.pandas_udf("double")
    def toxicity(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return docs.select("doc_id", toxicity("text").alias("score")).withColumn("predicted", (F.col("score") >= cutoff).cast("int"))
