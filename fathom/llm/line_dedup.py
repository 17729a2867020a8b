"""Line dedup over range-partitioned hashes.

Lines become (hash, document, position). They are range-partitioned by hash and document with a secondary sort by
position, so a hash that a third of all lines share spreads over many partitions. Each sorted partition is read as a
stream: a row that follows another hash or document opens one, and each run becomes its first occurrence and its
number of documents; runs that a range border cuts are added up. What returns to the documents is a keep bitmap as run lengths (kept, dropped, kept, ...), not text.

Defined cases: null or empty text is one empty line; keys without a character never go; rows with equal id and text
are one document and get equal results; null ids are ids like any other; an empty table gives an empty result;
extra columns are ignored by ``deduplicate`` and kept by ``apply``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.texts import BLANKS, ascii_lower, filled, twin_hash
from fathom.session import cut

DOC = ["doc_id", "doc_hash"]


def _with_doc_key(docs: DataFrame) -> DataFrame:
    text = filled("text")
    return docs.select("doc_id", F.xxhash64("doc_id", text).alias("doc_hash"), text.alias("text"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_rows(docs: DataFrame) -> DataFrame:
    """One row per line with a key of one character or more."""
    key = ascii_lower(F.btrim(F.col("line"), F.lit(BLANKS)))
    low, high = twin_hash(F.col("key"))
    return (
        _with_doc_key(docs)
        .select(*DOC, F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
        .select(*DOC, "pos", key.alias("key"))
        .where(F.col("key") != "")
        .select(low.alias("h1"), high.alias("h2"), *DOC, "pos")
    )


def occurrences(rows: DataFrame) -> DataFrame:
    """h1, h2, n_docs and first (occurrence, by document and position) of each key of ``rows``.

    The rows are sorted once: a row opens a document if the row before it has another key or document. Each
    partition streams into one row a key, and keys that a range border cuts are added up across it."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["h1", "h2", *DOC]
    before = F.lag("pos").over(Window.partitionBy(*key).orderBy("pos"))
    streamed = rows.repartitionByRange(parts, *key).sortWithinPartitions(*key, "pos").withColumn("opens", before.isNull())
    return streamed.where("opens").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct(*DOC, "pos")).alias("first"))


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """doc_id, doc_hash, n_dropped and the bitmap as run lengths, for documents that lose a line.

    Keys in ``min_docs`` documents or more lose all their lines, or all but the first in order of document and
    position if ``keep_first``."""
    rows = cut(line_rows(docs), "lines")
    common = occurrences(rows).where(F.col("n_docs") >= min_docs)
    common = cut(common.select("h1", "h2", "first"), "common")  # apart from its counting, so that the join can split a hot line
    dropped = rows.join(common, ["h1", "h2"])
    if keep_first:
        dropped = dropped.where(~(F.struct(*DOC, "pos").eqNullSafe(F.col("first"))))
    gone = dropped.groupBy(*DOC).agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    starts = F.filter("gone", lambda p, i: (i == 0) | (F.get("gone", i - 1) != p - 1))
    ends = F.filter("gone", lambda p, i: F.get("gone", i + 1).isNull() | (F.get("gone", i + 1) != p + 1))
    runs = F.flatten(
        F.transform(
            "starts",
            lambda s, i: F.array(s - F.coalesce(F.get("ends", i - 1) + 1, F.lit(0)), F.get("ends", i) - s + 1),
        )
    )
    return (
        gone.select(*DOC, F.size("gone").cast("long").alias("n_dropped"), starts.alias("starts"), ends.alias("ends"))
        .select(*DOC, "n_dropped", runs.alias("runs"))
    )


def kept_text(text: Column, runs: Column) -> Column:
    """The text without the dropped lines; runs as from ``keep_bitmaps``, null if all lines stay."""
    flags = F.flatten(F.transform(runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    kept = F.filter(
        F.arrays_zip(_lines(text).alias("line"), flags.alias("kept")), lambda x: F.coalesce(x["kept"], F.lit(True)) & x["line"].isNotNull()
    )
    return F.when(runs.isNull(), text).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))


def deduplicate(docs: DataFrame, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """doc_id, text (what stays), n_lines, n_dropped and runs for every document."""
    bitmaps = keep_bitmaps(docs, min_docs, keep_first).withColumnRenamed("doc_id", "id2").withColumnRenamed("doc_hash", "hash2")
    own = _with_doc_key(docs)
    met = own["doc_id"].eqNullSafe(bitmaps["id2"]) & (own["doc_hash"] == bitmaps["hash2"])
    return own.join(bitmaps, met, "left").select(
        "doc_id",
        kept_text(F.col("text"), F.col("runs")).alias("text"),
        F.size(_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        "runs",
    )
