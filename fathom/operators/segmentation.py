"""Segments, sections and chunks of documents, as rows. Nothing crosses a segment's border."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import text as tx

SECTION_CHARS = 180


def _runs(rows: DataFrame, titles: Callable[[Column], Column]) -> tuple[DataFrame, Column]:
    """The rows, and an expression of them: run (from 0; 0 is what comes before the first title), title and body of every
    run of lines from one title line to the next that is not blank. All within the row: nothing is shuffled, rows never mix.

    The expression is exploded as it is: of a column by name, Spark would infer a filter on its size and evaluate the
    split of the whole text for every line of it, below the projections that hold the lines."""
    held = rows.columns
    split = rows.select(*held, F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n").alias("_lines"))
    titled = split.select(*held, "_lines", F.transform("_lines", titles).alias("_titles"))
    opens = F.filter(F.sequence(F.lit(0), F.size("_titles") - 1), lambda i: F.get("_titles", i).isNotNull())
    begun = titled.select(*held, "_lines", "_titles", F.concat(F.array(F.lit(0)), opens).alias("_begins"))
    body = lambda b, i: tx.strip(F.array_join(F.slice("_lines", b + 1, F.coalesce(F.get("_begins", i + 1), F.size("_lines")) - b), "\n"))
    made = F.transform("_begins", lambda b, i: F.struct(i.cast("long").alias("run"), F.when(i > 0, F.get("_titles", b)).alias("title"), body(b, i).alias("body")))
    return begun, F.filter(made, lambda r: r["body"] != "")


def markdown_segments(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, location_index (from 1, blank segments take none), section, text. A heading line opens a segment and stays."""
    heading = lambda line: F.when(line.rlike(tx.MARKDOWN_HEADING), tx.strip(F.regexp_extract(line, tx.MARKDOWN_HEADING, 1)))
    lines, runs = _runs(docs.select(*keys, "text"), heading)
    found = lines.select(*keys, F.posexplode(runs).alias("pos", "r"))
    return found.select(*keys, (F.col("pos") + 1).cast("long").alias("location_index"), F.substring(F.coalesce("r.title", F.lit(tx.BODY)), 1, SECTION_CHARS).alias("section"), F.col("r.body").alias("text"))


def _named(rows: DataFrame) -> Callable[[Column], Column]:
    """Section of a run: its title, else the row's own ``section`` if that column is there, else the default."""
    hint = F.coalesce(F.nullif("section", F.lit("")), F.lit(tx.BODY)) if "section" in rows.columns else F.lit(tx.BODY)
    return lambda title: F.substring(F.coalesce(title, hint), 1, SECTION_CHARS)


def sections(segments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, run (order within the segment), section, text: each segment split at title lines. A segment's own
    ``section``, if that column is there, names what comes before the first title."""
    kept = [*keys, "text", *(["section"] if "section" in segments.columns else [])]
    name = _named(segments)
    lines, runs = _runs(segments.select(*kept), tx.section_title)
    found = lines.select(*kept, F.explode(runs).alias("_r"))
    return found.select(*keys, F.col("_r.run").alias("run"), name(F.col("_r.title")).alias("section"), F.col("_r.body").alias("text"))


def document_chunks(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, run, section, chunk_index (one counter a row, from 0), text: sections and their overlapping windows of
    documents that are one row each, within the row."""
    kept = [*keys, "text", *(["section"] if "section" in docs.columns else [])]
    name = _named(docs)
    cutup = lambda r: F.transform(tx.chunk_starts(r["body"]), lambda s: F.struct(r["run"].alias("run"), name(r["title"]).alias("section"), tx.strip(tx.window(r["body"], s)).alias("text")))
    lines, runs = _runs(docs.select(*kept), tx.section_title)
    pieces = F.filter(F.flatten(F.transform(runs, cutup)), lambda c: c["text"] != "")
    return lines.select(*keys, F.posexplode(pieces).alias("pos", "c")).select(*keys, "c.run", "c.section", F.col("pos").cast("long").alias("chunk_index"), "c.text")


def text_chunks(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, chunk_index (from 0), text: the overlapping windows of whole texts, within the row."""
    windows = F.filter(F.transform(tx.chunk_starts(F.col("text")), lambda s: tx.strip(tx.window(F.col("text"), s))), lambda t: t != "")
    return docs.select(*keys, F.posexplode(windows).alias("pos", "chunk")).select(*keys, F.col("pos").cast("long").alias("chunk_index"), F.col("chunk").alias("text"))


def chunks(parts: DataFrame, doc_keys: list[str], order: list[str]) -> DataFrame:
    """doc_keys, order, section, chunk_index (one counter a document, from 0), text of the overlapping windows."""
    kept = [*doc_keys, *order, "section"]
    cutup = parts.select(*kept, F.explode(tx.chunk_starts(F.col("text"))).alias("start"), "text").select(*kept, "start", tx.strip(tx.window(F.col("text"), F.col("start"))).alias("text"))
    index = F.row_number().over(Window.partitionBy(*doc_keys).orderBy(*order, "start")) - 1
    return cutup.where("text <> ''").select(*kept, index.cast("long").alias("chunk_index"), "text")


def unit_count(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Highest location index, or the number of segments if none has one."""
    return segments.groupBy(*keys).agg(F.coalesce(F.nullif(F.max("location_index"), F.lit(0)), F.count(F.lit(1))).cast("long").alias("unit_count"))
