"""Language identification by error-correcting output codes.

Each language has a codeword; one binary classifier a bit, over hashed character 1- to 3-grams of the whole text,
predicts the bits. A classifier is the log ratio of n-gram rates between the languages with that bit set and the
others, scaled by how its margins spread on the sample. Decoding sums the losses of all bits, weighted by how well
each bit separates, and takes the codeword of the least loss. A text is ambiguous if its two best codewords are closer
than those of nearly all learned texts of its length (mixed texts), or if it is farther from every codeword than all of
them (a language never learned, noise): short texts lie nearer to each other, so both limits go by length class.

Learning uses at most about ``PER_LANGUAGE`` documents a language, distinct in id or text, written apart once; counts by language and n-gram
bucket are summed by Spark, and only those (languages x ``BUCKETS``) and the limits by length class reach the driver.

Defined cases: null texts and texts without a letter are ``und`` with score 0; with a single learned language every
other text is that language; with none, ``und``; null ids are never held out and are learned
from like others; repeated rows count once; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.sampling import drawn
from fathom.session import cut

PER_LANGUAGE = 2000
BUCKETS = 1 << 15
BITS = 15
SHARPNESS = 12.0  # how fast the score falls with the loss
MARGIN = 0.02  # ambiguous if the best codeword has less than so much more of the weight than the next
CLASSES = 32  # length classes: powers of two of the characters
LOW = 0.005  # quantile of the learned texts' gaps between the two best codewords
NEARER = 0.5  # ambiguous below so much of that gap
FARTHER = 0.25  # ambiguous so far beyond the largest learned loss, of the way to the loss of a text that says nothing
_BLOCK = 1 << 20


def gram_counts(text: str) -> np.ndarray:
    """Counts by bucket of the 1- to 3-grams; anything that is no letter counts as one blank."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where((codes < 128) & ((codes < 97) | (codes > 122)), np.uint32(32), codes)
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(codes), _BLOCK):
        c = codes[max(0, at - 2) : at + _BLOCK]
        own = min(at, 2)
        one = c * np.uint32(0x9E3779B1)
        two = one[1:] ^ (c[:-1] * np.uint32(0x85EBCA77))
        three = two[1:] ^ (c[:-2] * np.uint32(0xC2B2AE3D))
        for grams, skip in ((one, own), (two, max(0, own - 1)), (three, 0)):
            total += np.bincount(((grams[skip:] * np.uint32(0x27D4EB2F)) >> np.uint32(17)).astype(np.int64), minlength=BUCKETS)
    return total


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def length_class(text: str) -> int:
    return min(CLASSES, len(text).bit_length()) - 1


def codewords(n: int, bits: int = BITS) -> np.ndarray:
    """n x bits of +-1: all splits for up to five languages, else columns that best separate the closest pair."""
    if n <= 5:
        columns = [(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(columns, np.int8).T.reshape(n, -1)
    rng = np.random.default_rng(7)
    bits = max(bits, 4 * int(np.ceil(np.log2(n))))
    best, widest = None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        gaps = (code[:, None, :] != code[None, :, :]).sum(axis=2) + bits * np.eye(n, dtype=int)
        if gaps.min() > widest:
            best, widest = code, gaps.min()
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # BUCKETS x bits
    middle: np.ndarray  # by bit: margin where both sides are equally near
    scale: np.ndarray  # by bit: spread of the margins
    trust: np.ndarray  # by bit: weight of its loss
    least_gap: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES))  # by length class
    most_loss: np.ndarray = field(default_factory=lambda: np.full(CLASSES, np.inf))  # by length class

    def margins(self, text: str) -> np.ndarray:
        counts = gram_counts(text)
        used = np.flatnonzero(counts)
        return counts[used] @ self.weights[used] / max(1, counts.sum())

    def losses(self, text: str) -> np.ndarray:
        """By language: weighted exponential loss of the codeword; 1 where no bit has a margin."""
        m = np.clip((self.margins(text) - self.middle) / self.scale, -4, 4)
        return (np.exp(-self.code * m) * self.trust).sum(axis=1) / self.trust.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, ambiguous."""
        if not self.languages or not has_letter(text):
            return "und", 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        loss = self.losses(text)
        share = np.exp(-SHARPNESS * (loss - loss.min()))
        share /= share.sum()
        order = np.argsort(-share, kind="stable")
        best, second = loss[order[:2]]
        tie = share[order[0]] - share[order[1]] < MARGIN
        size = length_class(text)
        return self.languages[order[0]], float(share[order[0]]), bool(tie or second - best < self.least_gap[size] or best > self.most_loss[size])


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        for text, lang in zip(b.column(0), b.column(1), strict=True):
            if has_letter(text.as_py()):
                sums[lang.as_py()] = sums.get(lang.as_py(), 0) + gram_counts(text.as_py())
    for lang, counts in sums.items():
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used)), pa.array(used.astype(np.int32)), pa.array(counts[used])], ["lang", "bucket", "n"])


def _margin_batches(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1), strict=True):
                if has_letter(text.as_py()):
                    m = model.margins(text.as_py())
                    sums[lang.as_py()] = sums.get(lang.as_py(), 0) + np.stack([np.ones_like(m), m, m * m], axis=1)
        for lang, s in sums.items():
            columns = [pa.array([lang] * len(s)), pa.array(np.arange(len(s), dtype=np.int32)), *(pa.array(c) for c in s.T)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "bit", "n", "s", "ss"])

    return run


def _distance_batches(model: Model) -> Callable:
    """Length class, least loss and gap to the second of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t for t in b.column(0).to_pylist() if has_letter(t)]
            near = np.array([np.sort(model.losses(t))[:2] for t in texts]).reshape(-1, 2)
            columns = [pa.array([length_class(t) for t in texts], pa.int32()), pa.array(near[:, 0]), pa.array(near[:, 1] - near[:, 0])]
            yield pa.RecordBatch.from_arrays(columns, ["size", "loss", "gap"])

    return run


def _limits(model: Model, sample: DataFrame) -> None:
    """Sets the limits of ambiguity. Each class takes the milder of its own and those of longer texts; classes longer
    than all learned texts take the last, shorter ones reject nothing."""
    seen = sample.mapInArrow(_distance_batches(model), "size int, loss double, gap double").groupBy("size")
    seen = {r["size"]: r for r in seen.agg(F.max("loss").alias("loss"), F.percentile("gap", F.lit(LOW)).alias("gap")).collect()}
    loss, gap = -np.inf, np.inf
    for size in sorted(seen, reverse=True):
        longest = loss == -np.inf
        loss, gap = max(loss, seen[size].loss), min(gap, seen[size].gap)
        reach = slice(size, CLASSES if longest else size + 1)
        model.most_loss[reach] = loss + FARTHER * max(0.0, 1 - loss)
        model.least_gap[reach] = NEARER * gap


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """``labelled``: doc_id, text and lang of the documents to learn from."""
    keys = {"_id": F.col("doc_id"), "_text": F.xxhash64("text")}
    sample = cut(drawn(labelled.select("doc_id", "text", "lang"), "lang", per_language, keys=keys).select("text", "lang"), "sample")
    summed = sample.mapInArrow(_count_batches, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(summed["lang"].unique())
    rates = np.zeros((len(languages), BUCKETS))
    for i, lang in enumerate(languages):
        own = summed[summed["lang"] == lang]
        rates[i, own["bucket"]] = own["n"]
    if len(languages) < 2:
        return Model(languages, np.zeros((len(languages), 0)), np.zeros((BUCKETS, 0)), *(np.zeros(0),) * 3)
    rates = (rates + 0.5) / (rates.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
    code = codewords(len(languages))
    weights = np.stack([np.log(rates[bit > 0].mean(axis=0) / rates[bit < 0].mean(axis=0)) for bit in code.T], axis=1).astype(np.float32)
    flat = np.ones(code.shape[1])
    model = Model(languages, code, weights, 0 * flat, flat, flat)
    spread = sample.mapInArrow(_margin_batches(model), "lang string, bit int, n double, s double, ss double").groupBy("lang", "bit").sum("n", "s", "ss").toPandas()
    for k in range(code.shape[1]):
        sides = []
        for sign in (1, -1):
            own = spread[(spread["bit"] == k) & spread["lang"].isin([x for x, c in zip(languages, code[:, k], strict=True) if c == sign])]
            n, s, ss = (own[f"sum({c})"] for c in ("n", "s", "ss"))
            mean = float((s / n).mean())
            sides.append((mean, float(((ss / n) - (s / n) ** 2).clip(lower=0).mean()) ** 0.5 + 1e-6))
        (high, sd1), (low, sd0) = sides
        model.middle[k] = (high * sd0 + low * sd1) / (sd1 + sd0)
        model.scale[k] = max(1e-6, (high - low) / 4)
        model.trust[k] = min(10.0, max(0.1, (high - low) / (sd1 + sd0)))
    _limits(model, sample)
    return model


def predictor(spark: SparkSession, model: Model) -> Callable[[str], Column]:
    """A column function of the text: struct of lang_pred, score, ambiguous. The model is of a fixed size."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score", "ambiguous"])

    return predict


def identify(docs: DataFrame, learn_from: DataFrame) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every row."""
    predict = predictor(docs.sparkSession, train(learn_from))
    return docs.select("doc_id", predict("text").alias("found")).select("doc_id", "found.*")


def keep_identified(docs: DataFrame, learn_from: DataFrame) -> DataFrame:
    """The rows, with all columns, whose language is certain."""
    predict = predictor(docs.sparkSession, train(learn_from))
    return docs.where(~predict("text")["ambiguous"])
