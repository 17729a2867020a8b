"""What outside layout engines leave behind: paged Markdown, and content lists in JSON. PDF and OCR engines are
plug-ins that write such files; the rules for using native text are plain expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.text import BODY, strip

LEAST_NATIVE_CHARS = 20
MARK = r"(?m)^\{([0-9]+)\}-{3,}\s*$"
# Keys of a block that hold text, in order.
CONTENT_KEYS = ("text", "content", "list_items", "table_body", "table_caption", "image_caption", "image_footnote", "equation_latex")


def needs_ocr(page_text: Column) -> Column:
    """A page with hardly any text of its own is read by OCR."""
    return F.length(F.regexp_replace(F.coalesce(page_text, F.lit("")), r"\s+", "")) < LEAST_NATIVE_CHARS


def paged_markdown(rows: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """keys, page (from 1), text. Without page marks all is page 0: pages are never guessed."""
    text = F.coalesce(F.col(column), F.lit(""))
    numbers = F.transform(F.regexp_extract_all(text, F.lit(MARK), F.lit(1)), lambda n: n.cast("long") + 1)
    bodies = F.split(text, MARK)
    pages = F.when(F.size(numbers) == 0, F.array(F.struct(F.lit(0).cast("long").alias("page"), text.alias("text")))).otherwise(
        F.zip_with(numbers, F.slice(bodies, 2, F.size(bodies)), lambda n, b: F.struct(n.alias("page"), b.alias("text")))
    )
    return rows.select(*keys, F.explode(pages).alias("p")).select(*keys, "p.page", strip(F.col("p.text")).alias("text")).where("text <> ''")


def content_list(rows: DataFrame, keys: list[str], column: str = "payload") -> DataFrame:
    """keys, page (from 1), text of a JSON list of blocks with page_idx, or an object that holds it as content_list: all
    texts of a block, then a page's blocks in order. Blocks without a page are left out."""
    block = "array<struct<page_idx:bigint," + ",".join(f"{k}:string" for k in CONTENT_KEYS) + ">>"
    payload = F.coalesce(F.get_json_object(column, "$.content_list"), F.col(column))
    blocks = rows.select(*keys, F.from_json(payload, block).alias("blocks")).select(*keys, F.posexplode("blocks").alias("n", "b"))
    join = lambda parts: F.array_join(F.filter(F.transform(parts, strip), lambda t: t != ""), "\n")
    # Lists inside a block arrive as JSON text.
    flat = lambda c: F.when(c.rlike(r"^\s*\["), join(F.from_json(c, "array<string>"))).otherwise(c)
    text = join(F.array(*(F.coalesce(flat(F.col(f"b.{k}")), F.lit("")) for k in CONTENT_KEYS)))
    found = blocks.where("b.page_idx is not null").select(*keys, "n", (F.col("b.page_idx") + 1).alias("page"), text.alias("text")).where("text <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n")
    return found.groupBy(*keys, "page").agg(joined.alias("text"))


def as_segments(pages: DataFrame, document_type: Column) -> DataFrame:
    """Adds location_type, location_index and section by document type."""
    kind = F.when(F.col("page") == 0, "heading").when(document_type == "pptx", "slide").when(document_type == "html", "web_section").when(document_type == "docx", "heading").otherwise("page")
    return pages.withColumns({"location_type": kind, "location_index": F.col("page"), "section": F.lit(BODY)})
