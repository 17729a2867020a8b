"""Quality: a weak-label model whose posterior labels train a hashed linear scorer.

Heuristic labellers vote good (1), bad (0) or abstain (-) on each whole text; most only ever vote bad. Documents are summed by vote pattern
over the whole corpus (3 ** labellers patterns at most); expectation-maximisation over those sums estimates how
often each labeller is right on good and on bad documents, and so the posterior of each pattern. Posteriors of a
sample of about ``TRAIN_DOCS`` documents train a logistic scorer over hashed character 1- to 3-grams, which then
scores every document.

Defined cases: a null text is empty; empty texts get the votes of short ones; an empty table gives an empty result;
repeated rows score alike (each counts in the sums); null ids are allowed; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import linear
from fathom.llm.sampling import bounded
from fathom.session import cut

TRAIN_DOCS = 6_000
BUCKETS = 1 << 16
KEEP = 0.5
FALSE_ALARMS = 0.01  # a labeller is taken to call at most this share of good documents bad
_BLOCK = 1 << 20
_SYMBOLS = re.compile(r"[#$%&*+<=>@^_`{|}~\\]")
LABELLERS = ("symbols", "stutter", "word length", "sentences", "short words", "line repeats", "length", "capitals")


def _vote(x: float, bad: bool, good: bool) -> int:
    return 0 if bad else 1 if good else -1


def votes(text: str | None) -> str:
    """One character a labeller: 1 good, 0 bad, - abstains."""
    text = text or ""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    symbols = len(_SYMBOLS.findall(text)) / n
    stutter = sum(map(str.__eq__, words, words[1:])) / n
    length = sum(map(len, words)) / n
    stops = (text.count(".") + text.count("!") + text.count("?")) / n
    short = sum(len(w) <= 3 for w in words) / n
    lines = [x for x in text.split("\n") if x.strip()]
    unlike = len(set(lines)) / max(1, len(lines))
    capitals = sum(map(str.isupper, text)) / chars
    found = (
        _vote(symbols, symbols > 0.1, False),
        _vote(stutter, stutter > 0.04, False),
        _vote(length, not 2.5 <= length <= 9, False),
        _vote(stops, stops < 0.01 or stops > 0.6, 0.03 <= stops <= 0.3),
        _vote(short, short < 0.12, False),
        _vote(unlike, len(lines) > 3 and unlike < 0.6, False),
        _vote(n, len(words) < 5, False),
        _vote(capitals, capitals > 0.2, False),
    )
    return "".join("01-"[v] for v in found)


def expectation_maximisation(patterns: list[str], counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good by pattern, rates of the outcomes (labellers x [bad, good] x [says bad, says good, abstains])
    and the share of good. Abstaining is an outcome: a labeller that only ever says bad tells by how seldom it does."""
    said = np.array([[[c == o for o in "01-"] for c in p] for p in patterns], float)  # patterns x labellers x outcomes
    start = [[0.4, 0.25, 0.35], [0.05, 0.5, 0.45]]
    rates, share = np.tile(np.array(start), (said.shape[1], 1, 1)), 0.8
    post = np.full(len(patterns), share)
    for _ in range(rounds):
        bad, good = (np.einsum("plo,lo->p", said, np.log(rates[:, k])) for k in (0, 1))
        new = 1 / (1 + np.exp(np.clip(bad + np.log(1 - share) - good - np.log(share), -50, 50)))
        moved, post = np.abs(new - post).max(), new
        share = float(np.clip((post * counts).sum() / counts.sum(), 0.02, 0.98))
        for k, weight in ((0, (1 - post) * counts), (1, post * counts)):
            seen = np.einsum("p,plo->lo", weight, said) + np.array(start[k])
            rates[:, k] = seen / seen.sum(axis=1, keepdims=True)
        rates[:, 1, 0] = np.minimum(rates[:, 1, 0], FALSE_ALARMS)
        if moved < 1e-6:
            break
    return post, rates, share


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character 1- to 3-grams with log counts, scaled to length one."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where((codes >= 48) & (codes <= 57), np.uint32(48), codes)
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(codes), _BLOCK):
        c = codes[at : at + _BLOCK + 2]
        h = np.zeros(len(c), np.uint32)
        for n in (1, 2, 3):
            if len(c) >= n:
                h = (h[: len(c) - n + 1] * np.uint32(0x01000193)) ^ c[n - 1 :]
                total += np.bincount(((h * np.uint32(0x9E3779B1) + np.uint32(n)) >> np.uint32(16)).astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(total)
    x = np.log1p(total[at])
    return at, x / max(1e-9, float(np.sqrt(x @ x)))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        at, x = features(text or "")
        return linear.sigmoid(self.bias + float(self.weights[at] @ x))


def assess(docs: DataFrame, most: int = TRAIN_DOCS, keep: float = KEEP) -> DataFrame:
    """doc_id, votes, posterior (of the weak-label model), score (of the scorer) and keep of every row."""
    spark = docs.sparkSession

    @F.pandas_udf("string")
    def vote(texts: pd.Series) -> pd.Series:
        return pd.Series([votes(t) for t in texts], dtype="object")

    voted = cut(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), vote("text").alias("votes")), "votes")
    sums = voted.groupBy("votes").count().orderBy("votes").collect()  # 3 ** labellers rows at most
    if not sums:
        return voted.select("doc_id", "votes", F.lit(0.0).alias("posterior"), F.lit(0.0).alias("score"), F.lit(True).alias("keep"))
    post, _, _ = expectation_maximisation([r["votes"] for r in sums], np.array([r["count"] for r in sums], float))
    posterior = F.broadcast(spark.createDataFrame([(r["votes"], float(p)) for r, p in zip(sums, post, strict=True)], "votes string, posterior double"))
    chosen, _ = bounded(voted.join(posterior, "votes").withColumn("all", F.lit(1)), "all", most, "text_hash")
    # Equal texts are drawn together, so a copied text may exceed the bound: one row a text is enough.
    chosen = chosen.groupBy("text_hash").agg(F.first("posterior").alias("posterior"))
    chosen = F.broadcast(chosen.withColumnRenamed("text_hash", "chosen"))
    sample = docs.select("doc_id", "text").join(chosen, F.xxhash64("text") == F.col("chosen")).dropDuplicates(["chosen"])
    w, bias = linear.fit_on_one(linear.featurized(sample, features, "posterior"), BUCKETS, epochs=6, rate=0.3)
    shared = spark.sparkContext.broadcast(Model(w, bias))

    @F.pandas_udf("double")
    def scorer(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    @F.pandas_udf("string")
    def vote_again(texts: pd.Series) -> pd.Series:
        return pd.Series([votes(t) for t in texts], dtype="object")

    scored = docs.select("doc_id", vote_again("text").alias("votes"), scorer("text").alias("score"))
    return scored.join(posterior, "votes").select("doc_id", "votes", "posterior", "score", (F.col("score") >= keep).alias("keep"))
