"""Fuzzy name scores: equality, containment, pairs of characters; sequence matching in an Arrow UDF."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CUT = 0.42


def normal(name: str | None) -> str:
    """``normalized`` of one name."""
    return re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", name or "").casefold())


@F.pandas_udf(T.StringType())
def python_folded(names: pd.Series) -> pd.Series:
    return names.map(lambda n: unicodedata.normalize("NFKC", n or "").casefold())


def folded(name: Column) -> Column:
    """NFKC and full case folding. As an expression it passes Python (as null, for ASCII names); ``operators.names`` does not."""
    filled = F.coalesce(name, F.lit(""))
    plain = F.octet_length(filled) == F.length(filled)
    return F.when(plain, F.lower(filled)).otherwise(python_folded(F.when(~plain, filled)))


def normalized(name: Column) -> Column:
    """Normalised (NFKC), case folded, letters and digits only."""
    return F.regexp_replace(folded(name), r"(?U)[\W_]+", "")


def stem(name: Column) -> Column:
    """The name without its last extension, of a path of its last part; dots that only dots come before are no extension."""
    return F.regexp_replace(name, r"(?s)^((?:.*/)?\.*[^./][^/]*)\.[^./]*$", "$1")


def bigrams(text: Column) -> Column:
    made = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(made))


def dice(a: Column, b: Column) -> Column:
    left, right = bigrams(a), bigrams(b)
    total = F.size(left) + F.size(right)
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(left, right)) / total)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _ratio(query: Column, name: Column) -> Column:
    """The sequence ratio where it can matter: of names it cannot lift over the share of characters that the shorter
    of the two leaves possible, nor over what equality or containment have settled, Python sees nothing."""
    shorter, total = F.least(F.length(query), F.length(name)), F.length(query) + F.length(name)
    open_ = (shorter > 0) & ~F.contains(name, query) & (0.88 * 2 * shorter / total > F.greatest(F.lit(CUT), 0.92 * dice(query, name)))
    return F.when(open_, sequence_ratio(F.when(open_, query), F.when(open_, name))).otherwise(0.0)


def score(query: Column, name: Column, inexact: Column) -> Column:
    return (
        F.when((query == "") | (name == ""), 0.0)
        .when(query == name, 1.0)
        .when(F.contains(name, query), F.least(F.lit(0.99), 0.9 + 0.09 * F.length(query) / F.length(name)))
        .when(F.length(query) == 1, 0.0)
        .otherwise(inexact)
    )


def dice_score(query: Column, name: Column) -> Column:
    """The score without sequence matching; both sides normalised."""
    return score(query, name, 0.92 * dice(query, name))


def name_score(wanted: Column, full: Column, bare: Column) -> Column:
    """Best score of the full name and its stem, as rounded in results; all three normalised, as columns of their own.
    Scores below ``CUT`` may come out lower than they are."""
    scores = [score(wanted, n, F.greatest(0.88 * _ratio(wanted, n), 0.92 * dice(wanted, n))) for n in (full, bare)]
    return F.round(F.greatest(*scores), 4)


def scored(rows: DataFrame, query: Column, name: str = "name") -> DataFrame:
    """Adds score, of the ``name`` column against the query."""
    held = rows.columns
    ready = rows.select(*held, normalized(query).alias("_wanted"), normalized(F.col(name)).alias("_full"), normalized(stem(F.col(name))).alias("_bare"))
    return ready.withColumn("score", name_score(F.col("_wanted"), F.col("_full"), F.col("_bare"))).drop("_wanted", "_full", "_bare")
