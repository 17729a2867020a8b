"""Document fingerprints by one-permutation MinHash.

Every five-word shingle of the whole text is hashed once; the top byte of the hash is its bin, and each of the
``BINS`` bins keeps its least hash. An empty bin takes the value of a filled one by optimal densification: it probes
bins in an order that depends on its own number alone and takes the first that is filled; after ``PROBES`` misses it
takes the filled bin that hashes lowest together with its own number, which is the same rule over all bins at once.
The fingerprint stores the low eight bits of each bin; likeness is the share of equal bins, corrected for the 1 in
256 that agree by chance.

All of it is SQL functions on arrays within a row: no row leaves its task but for the neighbour comparison, which
range-partitions the documents by id and text hash once and carries one row over each border. Null and repeated ids
spread over the ranges by their texts; only rows of equal id and equal text stay together.

Defined cases: a null text is empty; texts without a word share one fingerprint; fewer than five words are one
shingle; null ids come last; repeated rows are neighbours of each other; a single document is its own neighbour; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.texts import filled, words
from fathom.session import cut

BINS = 256
SHINGLE = 5
PROBES = 8
_REST = (1 << 56) - 1  # the bits below the bin number


def _empty(value: Column) -> Column:
    return value.bitwiseAND(F.lit(_REST)) == _REST


def _bin(value: Column) -> Column:
    return F.shiftright(value, 56)


def codes(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: the low eight bits of each bin of column ``text``, as array<smallint>."""
    held = rows.columns
    step = lambda df, name, value: df.select(*held, value.alias(name))
    hashed = step(rows, "_words", F.transform(words(F.lower(filled(text))), lambda w: F.xxhash64(w)))
    shingle = lambda i: F.xxhash64(*(F.get("_words", i + k) for k in range(SHINGLE)))
    places = F.sequence(F.lit(0), F.greatest(F.size("_words") - SHINGLE, F.lit(0)))
    made = F.when(F.size("_words") > 0, F.transform(places, shingle)).otherwise(F.array().cast("array<bigint>"))
    marks = F.array(*(F.lit((b << 56) | _REST) for b in range(-BINS // 2, BINS // 2)))  # one empty value a bin
    ordered = step(hashed, "_sorted", F.sort_array(F.concat(made, marks)))
    leads = lambda x, i: (i == 0) | (_bin(x) != _bin(F.get("_sorted", i - 1)))
    least = step(ordered, "_bins", F.filter("_sorted", leads))
    with_full = least.select(*held, "_bins", F.filter("_bins", lambda x: ~_empty(x)).alias("_full"))

    def dense(x: Column, i: Column) -> Column:
        probes = [F.get("_bins", F.pmod(F.xxhash64(i, F.lit(a)), F.lit(BINS)).cast("int")) for a in range(PROBES)]
        lowest = F.array_min(F.transform("_full", lambda v: F.struct(F.xxhash64(i, _bin(v)).alias("rank"), v.alias("value"))))["value"]
        return F.when(~_empty(x), x).otherwise(F.coalesce(*(F.when(~_empty(p), p) for p in probes), lowest, F.lit(0)))

    low = lambda x, i: dense(x, i).bitwiseAND(F.lit(255)).cast("smallint")
    return step(with_full, out, F.transform("_bins", low))


def packed(code: Column) -> Column:
    """The fingerprint as hex digits, two a bin."""
    return F.array_join(F.transform(code, lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets, 0 to 1."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(BINS))
    return F.greatest(F.lit(0.0), (equal - 1 / 256) / (1 - 1 / 256))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the packed fingerprint of every row."""
    return codes(docs.select("doc_id", "text"), "text", "code").select("doc_id", packed(F.col("code")).alias("fingerprint"))


def _order_key() -> Column:
    """Text that sorts as (null ids last, doc_id descending, text hash)."""
    digits = lambda x: F.lpad(F.hex(x.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    last, down = F.when(F.col("doc_id").isNull(), "1").otherwise("0"), F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))
    return F.concat(last, digits(down), digits(F.xxhash64(filled("text"))))


def _range_of(key: Column, tops: list[str]) -> Column:
    """Number of the range that a key falls in, by two short searches: the row of tops, then the place in it."""
    wide = max(1, round(len(tops) ** 0.5))
    rows = [tops[i : i + wide] for i in range(0, len(tops), wide)]
    upto = lambda found: F.size(F.filter(found, lambda top: top <= key))
    row = F.greatest(upto(F.lit([r[0] for r in rows])) - 1, F.lit(0))
    return (row * wide + F.greatest(upto(F.get(F.array(*(F.lit(r) for r in rows)), row)) - 1, F.lit(0))).cast("int")


def with_next(docs: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """doc_id, text, code, next_text, next_code: each row beside the next in descending order of id; the last row
    is followed by the first."""
    spark = docs.sparkSession
    n = n_ranges or max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = cut(docs.select(_order_key().alias("key")), "keys")
    ranges = keys.repartitionByRange(n, "key").groupBy(F.spark_partition_id().alias("range")).agg(F.min("key").alias("top"))
    tops = sorted(r.top for r in ranges.collect())  # one a range
    rows = docs.select("doc_id", filled("text").alias("text"), _order_key().alias("key"))
    rows = rows.select("doc_id", "text", "key", _range_of(F.col("key"), tops or [""]).alias("range"), F.lit(0).alias("carried"))
    borders = [(tops[(i + 1) % len(tops)], i) for i in range(len(tops))]
    borders = F.broadcast(spark.createDataFrame(borders, "key string, into int"))
    carried = rows.join(borders, "key").dropDuplicates(["into"]).select("doc_id", "text", "key", F.col("into").alias("range"), F.lit(1).alias("carried"))
    both = codes(rows.union(carried), "text", "code")
    following = Window.partitionBy("range").orderBy("carried", "key")
    both = both.withColumns({"next_text": F.lead("text").over(following), "next_code": F.lead("code").over(following)})
    return both.where("carried = 0").select("doc_id", "text", "code", "next_text", "next_code")


def edited(docs: DataFrame) -> DataFrame:
    """Each document beside its edited text, whose last third comes from the start of the next document:
    doc_id, text, edited, code, edited_code, next_code."""
    third = F.floor(F.char_length("text") / 3).cast("int")
    new = F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 3) as int))"), F.substring("next_text", F.lit(1), third))
    return codes(with_next(docs).withColumn("edited", new).drop("next_text"), "edited", "edited_code")
