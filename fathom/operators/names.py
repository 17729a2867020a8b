"""Many names against many wanted ones, by the fuzzy score, without comparing all with all.

Distinct names and distinct wanted names are normalised once, and their distinct normal forms are compared, so copies of a name
cost nothing. Candidates come from inverted indexes that lose no pair with a score of ``cut`` or more:

- a form that contains the wanted one holds its rarest pair of characters: one posting list for each wanted name;
- pairs of characters: two sets whose Dice coefficient can reach the cut share a token among the rarest of each, so many
  that what remains could not reach it (prefix filter), and their sizes are not too unlike (length filter);
- characters: the matching blocks of two sequences use each character at most as often as both hold it, so the same two
  filters over (character, how many-th) bound the sequence ratio.

A candidate is checked for the full overlap before it is told apart, and the sequence matcher, the one step in Python,
sees only candidates whose bound beats both the cut and what the other scores give. Normal forms beyond ASCII take a
branch of their own, so that plain names never pass Python.

Defined cases: null and empty names match nothing, and neither do names of no letter or digit; a wanted name of one
character matches by equality and containment only; scores are rounded to four places after the cut is applied to the unrounded one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import fuzzy
from fathom.session import cut as written

SEQUENCE, PAIRS = 0.88, 0.92  # fixed weights of the two inexact scores


def plain(names: DataFrame, column: str) -> DataFrame:
    """``column`` and ``plain`` of the distinct names that are not null."""
    held = names.select(F.col(column).cast("string").alias(column)).where(F.col(column).isNotNull()).distinct()
    ascii_only = F.octet_length(column) == F.length(column)
    clean = lambda c: F.regexp_replace(c, r"(?U)[\W_]+", "")
    easy = held.where(ascii_only).select(column, clean(F.lower(column)).alias("plain"))
    return easy.unionByName(held.where(~ascii_only).select(column, clean(fuzzy.python_folded(F.col(column))).alias("plain")))


def numbered(text: Column) -> Column:
    """Each character with how many-th of its kind it is: as sets, these overlap as multisets of characters do."""
    apart = F.array_sort(F.split(text, ""))
    return F.flatten(F.transform(F.array(apart), lambda cs: F.transform(cs, lambda c, i: F.concat(c, (i - F.array_position(cs, c) + 1).cast("string")))))


def _prefixes(items: DataFrame, tokens: Column, counts: DataFrame, share: float) -> DataFrame:
    """item, n (tokens), rare (token): of each item its rarest tokens, one more than can be missed. An overlap of
    ``share`` x (n + m) / 2 is at least ``share`` / (2 - ``share``) x n, as m is no smaller than that."""
    spread = items.select("item", F.size(tokens).alias("n"), F.explode(tokens).alias("token"))
    ranked = spread.join(counts, "token").groupBy("item", "n").agg(F.array_sort(F.collect_list(F.struct("seen", "token"))).alias("all"))
    least = F.ceil(share / (2 - share) * F.col("n") - 1e-9)
    kept = F.slice("all", F.lit(1), (F.col("n") - F.greatest(least, F.lit(1)) + 1).cast("int"))
    return ranked.select("item", "n", F.explode(kept).alias("r")).select("item", "n", F.col("r.token").alias("rare"))


def _overlapping(wanted: DataFrame, forms: DataFrame, tokens, share: float) -> DataFrame:
    """wanted, form pairs whose token sets overlap by ``share`` (twice the overlap over the sum of the sizes) or more."""
    used = forms.select(F.explode(tokens(F.col("item"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("seen"))
    asked = wanted.select(F.explode(tokens(F.col("item"))).alias("token")).distinct()
    counts = written(used.join(asked, "token", "full_outer").select("token", F.coalesce("seen", F.lit(0).cast("long")).alias("seen")), "counts")
    left, right = (_prefixes(d, tokens(F.col("item")), counts, share) for d in (wanted, forms))
    right = right.select(F.col("item").alias("form"), F.col("n").alias("m"), "rare")
    limit = share / (2 - share)
    near = (F.col("m") >= limit * F.col("n") - 1e-9) & (F.col("n") >= limit * F.col("m") - 1e-9)
    pairs = left.join(right, "rare").where(near).select(F.col("item").alias("wanted"), "form").distinct()
    a, b = tokens(F.col("wanted")), tokens(F.col("form"))
    return pairs.where(2 * F.size(F.array_intersect(a, b)) >= share * (F.size(a) + F.size(b)) - 1e-9)


def _containing(wanted: DataFrame, forms: DataFrame) -> DataFrame:
    """wanted, form pairs where the form contains the wanted text: met at the wanted text's rarest pair of characters, or at
    its only character."""
    singles = lambda c: F.array_distinct(F.split(c, ""))
    keyed = lambda c: F.concat(F.transform(fuzzy.bigrams(c), lambda t: F.concat(F.lit("2"), t)), F.transform(singles(c), lambda t: F.concat(F.lit("1"), t)))
    own = F.when(F.length("item") == 1, F.array(F.concat(F.lit("1"), F.col("item")))).otherwise(F.transform(fuzzy.bigrams(F.col("item")), lambda t: F.concat(F.lit("2"), t)))
    postings = forms.select(F.col("item").alias("form"), F.explode(keyed(F.col("item"))).alias("token"))
    counts = postings.groupBy("token").agg(F.count(F.lit(1)).alias("seen"))
    asked = wanted.select("item", F.explode(own).alias("token")).join(written(counts, "counts"), "token")
    rarest = asked.groupBy(F.col("item").alias("wanted")).agg(F.min(F.struct("seen", "token")).alias("r")).select("wanted", F.col("r.token").alias("token"))
    return rarest.join(postings, "token").where(F.contains("form", F.col("wanted"))).select("wanted", "form")


def form_scores(wanted: DataFrame, forms: DataFrame, cut: float = fuzzy.CUT, sequence: bool = True) -> DataFrame:
    """wanted, form, score of the pairs of distinct normal forms (one column ``item`` each) with a score of ``cut`` or more."""
    wanted, forms = (written(d.where("item <> ''").distinct(), "items") for d in (wanted, forms))
    several = wanted.where(F.length("item") > 1)
    found = _containing(wanted, forms).unionByName(_overlapping(several, forms, fuzzy.bigrams, cut / PAIRS))
    if sequence:
        found = found.unionByName(_overlapping(several, forms, numbered, cut / SEQUENCE))
    return _scored(written(found.distinct(), "candidates"), cut, sequence)


def _scored(found: DataFrame, cut: float, sequence: bool) -> DataFrame:
    """The scores of candidates (wanted, form) from the cut on."""
    q, n = F.col("wanted"), F.col("form")
    exact = fuzzy.score(q, n, PAIRS * fuzzy.dice(q, n))
    if not sequence:
        return found.withColumn("score", exact).where(F.col("score") >= cut)
    most = 2 * F.size(F.array_intersect(numbered(q), numbered(n))) / (F.length(q) + F.length(n))
    told = found.withColumn("score", exact).withColumn("open", (F.length(q) > 1) & ~F.contains(n, q) & (SEQUENCE * most >= F.greatest(F.lit(cut), "score")))
    told = written(told, "told")
    settled = told.where(~F.col("open")).select("wanted", "form", "score")
    matched = told.where("open").select("wanted", "form", F.greatest("score", SEQUENCE * fuzzy.sequence_ratio(q, n)).alias("score"))
    return settled.unionByName(matched).where(F.col("score") >= cut)


def _held(names: DataFrame) -> DataFrame:
    """name and plain: the normal forms of each distinct name and of its stem."""
    stems = names.select("name", fuzzy.stem(F.col("name")).alias("stem")).distinct()
    return plain(names, "name").unionByName(stems.join(plain(stems, "stem"), "stem").select("name", "plain")).distinct()


def matches_one(names: DataFrame, query: str, cut: float = fuzzy.CUT, sequence: bool = True) -> DataFrame:
    """name, score: as ``matches`` for one query, which needs no index: every distinct form is scored once."""
    found = _held(names).where("plain <> ''").select("name", F.lit(fuzzy.normal(query)).alias("wanted"), F.col("plain").alias("form"))
    held = written(found, "held")
    scored = _scored(held.select("wanted", "form").distinct(), cut, sequence)
    return held.join(scored.drop("wanted"), "form").groupBy("name").agg(F.round(F.max("score"), 4).alias("score"))


def matches(names: DataFrame, queries: DataFrame, cut: float = fuzzy.CUT, sequence: bool = True) -> DataFrame:
    """query, name, score: distinct pairs of ``queries`` (query) and ``names`` (name); the better score of the whole name
    and of its stem."""
    asked = written(plain(queries, "query"), "asked")
    held = written(_held(names), "held")
    scored = form_scores(asked.select(F.col("plain").alias("item")), held.select(F.col("plain").alias("item")), cut, sequence)
    met = scored.join(asked.select("query", F.col("plain").alias("wanted")), "wanted").join(held.select("name", F.col("plain").alias("form")), "form")
    return met.groupBy("query", "name").agg(F.round(F.max("score"), 4).alias("score"))


def _shown(rows: DataFrame, limit: int) -> DataFrame:
    """Of rows of one name only the first ``limit`` can be in a result."""
    first = F.row_number().over(Window.partitionBy("name").orderBy(F.col("kind") != "folder", "id"))
    return rows.select("kind", "id", "name", first.alias("_place")).where(F.col("_place") <= limit).drop("_place")


def search(rows: DataFrame, queries: DataFrame, limit: int = 20, cut: float = fuzzy.CUT, sequence: bool = True) -> DataFrame:
    """query, kind, id, name, score, rank: for each query the best ``limit`` of the rows (kind, id, name), folders before
    files, then by name and id."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("kind") != "folder", "name", "id")
    met = matches(rows, queries, cut, sequence).join(_shown(rows, limit), "name")
    return met.select("query", "kind", "id", "name", "score", F.row_number().over(order).cast("long").alias("rank")).where(F.col("rank") <= limit)


def search_one(rows: DataFrame, query: str, limit: int = 20, cut: float = fuzzy.CUT) -> DataFrame:
    """kind, id, name, score: the best ``limit`` of the rows for one query, in order."""
    met = matches_one(rows, query, cut).join(_shown(rows, limit), "name")
    return met.select("kind", "id", "name", "score").orderBy(F.desc("score"), F.col("kind") != "folder", "name", "id").limit(limit)
