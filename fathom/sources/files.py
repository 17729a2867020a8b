"""Document files: listing, decoding, dispatch by type, previews, and change detection between listings."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.operators import intake
from fathom.operators.segmentation import markdown_segments
from fathom.sources import html, office

SEGMENT = "location_type string, location_index long, section string, text string, page long"


def listing(spark: SparkSession, folder: str, pattern: str = "*", content: bool = True) -> DataFrame:
    """path, modificationTime, length and (where asked for) content of all files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found if content else found.drop("content")


def decode(data: bytes | None) -> str | None:
    """UTF-16 by its mark, UTF-8 with or without one, else GB18030; null if nothing fits."""
    if data is None:
        return None
    if data.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
        order = ["utf-16"]
    else:
        order = ["utf-8-sig", "gb18030"]
    for name in order:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return None


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    return content.map(decode)


def validated(files: DataFrame, declared: str | None = None) -> DataFrame:
    """Adds file_name, document_type, sha256 and reject_reason to a listing."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    mime = F.col(declared) if declared else F.lit("")
    return files.withColumns(
        {
            "file_name": name,
            "document_type": intake.document_type(name),
            "sha256": F.sha2("content", 256),
            "reject_reason": F.coalesce(intake.reject_reason(name, F.col("content"), mime), office.archive_problem(intake.document_type(name), F.col("content"))),
        }
    )


def parsed(files: DataFrame) -> DataFrame:
    """path and segments of accepted files, each type by its own parser. PDF and images need an outside engine: see
    ``layout`` for what such an engine leaves behind."""
    good = files.where("reject_reason is null")
    texts = good.where(F.col("document_type").isin("markdown", "html")).select("path", "document_type", decoded("content").alias("text"))
    notes = markdown_segments(texts.where("document_type = 'markdown'").select("path", "text"), ["path"]).withColumn("location_type", F.lit("heading"))
    pages = html.segments(texts.where("document_type = 'html'"), ["path"], "text").withColumn("location_type", F.lit("web_section"))
    papers = office.segments(good.where(F.col("document_type").isin("docx", "pptx")), ["path"])
    order = ["path", "location_type", "location_index", "section", "text"]
    return notes.select(order).unionByName(pages.select(order)).unionByName(papers.select(order)).withColumn("page", F.lit(0).cast("long"))


def changed(before: DataFrame, now: DataFrame) -> DataFrame:
    """path and change (new or modified) between two listings; signatures are length and modification time."""
    old = before.select("path", F.col("length").alias("old_length"), F.col("modificationTime").alias("old_time"))
    both = now.join(old, "path", "left")
    kind = F.when(F.col("old_length").isNull(), "new").when((F.col("length") != F.col("old_length")) | (F.col("modificationTime") != F.col("old_time")), "modified")
    return both.withColumn("change", kind).where("change is not null").select("path", "change", "length", "modificationTime")


def queue_entries(files: DataFrame) -> DataFrame:
    """One row of each (name, length, time): the least path."""
    return files.groupBy("file_name", "length", "modificationTime").agg(F.min("path").alias("path"))
