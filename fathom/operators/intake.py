"""Validation, type detection, duplicates and import estimates. A row is never lost: it gets a reason instead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.session import cut

# Types by extension, their MIME types, limits.
TYPES = {".pdf": "pdf", ".docx": "docx", ".pptx": "pptx", ".md": "markdown", ".markdown": "markdown", ".html": "html", ".htm": "html"}
MIMES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "markdown": "text/markdown",
    "html": "text/html",
}
ALLOWED_MIMES = {
    "pdf": ["application/pdf"],
    "docx": [MIMES["docx"], "application/msword", "application/zip", "application/x-zip-compressed"],
    "pptx": [MIMES["pptx"], "application/vnd.ms-powerpoint", "application/zip", "application/x-zip-compressed"],
    "markdown": ["text/markdown", "text/plain", "text/x-markdown"],
    "html": ["text/html", "application/xhtml+xml", "text/plain"],
}
GENERIC_MIMES = ["", "application/octet-stream", "binary/octet-stream"]
UNITS = {"pdf": "page", "pptx": "slide", "docx": "heading", "markdown": "heading", "html": "web_section"}
ENGINE_ALIASES = {"pypdf": "pymupdf"}
NATIVE_ENGINES = {"docx": "python-docx", "pptx": "python-pptx", "markdown": "markdown", "html": "html"}
MOST_BYTES = 100 * 1024 * 1024


def _lookup(key: Column, values: dict[str, str]) -> Column:
    return F.coalesce(*(F.when(key == k, v) for k, v in values.items()))


def document_type(name: Column) -> Column:
    return _lookup(F.lower(F.regexp_extract(name, r"\.[^.]+$", 0)), TYPES)


def mime_type(kind: Column) -> Column:
    return _lookup(kind, MIMES)


def unit_type(kind: Column) -> Column:
    return _lookup(kind, UNITS)


def reject_reason(name: Column, content: Column, declared: Column) -> Column:
    """The first failing rule, or null."""
    kind, size = document_type(name), F.octet_length(content)
    mime = F.lower(F.trim(F.split_part(F.coalesce(declared, F.lit("")), F.lit(";"), F.lit(1))))
    fits = F.coalesce(*(F.when(kind == k, mime.isin(v)) for k, v in ALLOWED_MIMES.items()))
    head = F.substring(content, 1, 2 * 1024 * 1024)
    return F.coalesce(
        F.when(kind.isNull(), "unsupported type"),
        F.when(size.isNull() | (size == 0), "empty file"),
        F.when(size > MOST_BYTES, "too large"),
        F.when(~mime.isin(GENERIC_MIMES) & ~fits, "declared type does not match"),
        F.when((kind == "pdf") & (F.hex(F.substring(content, 1, 5)) != "255044462D"), "no PDF header"),
        F.when(kind.isin("docx", "pptx") & (F.hex(F.substring(content, 1, 2)) != "504B"), "no archive"),
        F.when(kind.isin("markdown", "html") & F.hex(head).rlike("^(?:[0-9A-F]{2})*?00"), "binary content"),
    )


def web_url_problem(url: Column) -> Column:
    """Why a page may not be fetched, or null: scheme, host, private or local addresses, credentials."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    private = r"^(?:localhost|.*\.local|.*\.internal|0\..*|10\..*|127\..*|169\.254\..*|192\.168\..*|172\.(?:1[6-9]|2[0-9]|3[01])\..*|\[?(?:::1|f[cd][0-9a-f]{2}:.*|fe80:.*)\]?)$"
    return F.coalesce(
        F.when(~scheme.isin("http", "https"), "scheme"),
        F.when(host == "", "no host"),
        F.when(host.rlike(private), "private host"),
        F.when(F.coalesce(F.try_parse_url(url, F.lit("USERINFO")), F.lit("")) != "", "credentials"),
    )


def trusted(url: Column, hosts: list[str]) -> Column:
    """https only, and the host or one below it."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    below = F.lit(False)
    for h in hosts:
        below = below | (host == h) | F.endswith(host, F.lit("." + h))
    return F.startswith(F.lower(url), F.lit("https://")) & below


def snapshot_filename(url: Column, sha: Column, title: Column) -> Column:
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    last = F.regexp_extract(path, r"([^/]*)$", 1)
    page = F.regexp_replace(F.when(last == "", "index").otherwise(last), r"(?<=[^.])\.[^.]*$", "")
    named = F.when(F.trim(F.coalesce(title, F.lit(""))) != "", F.trim(title)).otherwise(page)
    safe = F.regexp_replace(F.regexp_replace(named, "[^0-9A-Za-z㐀-鿿._-]+", "_"), r"^[._-]+|[._-]+$", "")
    safe = F.when(safe == "", "page").otherwise(safe)
    host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("website"))), "[^0-9A-Za-z.-]+", "_")
    base = F.regexp_replace(F.substring(F.concat_ws("_", host, safe, F.left(sha, F.lit(8))), 1, 170), r"[._-]+$", "")
    return F.concat(base, F.lit(".html"))


def upload_name(name: Column, sha: Column, taken: Column) -> Column:
    """The name, or with _sha8, _sha8_2 … before the extension; ``taken``: how often the name came before."""
    extension = F.regexp_extract(name, r"(?<=[^.])(\.[^.]*)$", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(extension))
    more = F.when(taken > 1, F.concat(F.lit("_"), taken.cast("string"))).otherwise("")
    return F.when(taken == 0, name).otherwise(F.concat(stem, F.lit("_"), F.left(sha, F.lit(8)), more, extension))


def effective_engine(kind: Column, wanted: Column) -> Column:
    """The engine that reads a type: layout engines where they can, the native one otherwise; PDF takes what is wanted."""
    wanted = F.coalesce(_lookup(wanted, ENGINE_ALIASES), wanted)
    layout = F.when(kind.isin("docx", "pptx"), wanted.isin("marker", "mineru")).when(kind == "html", wanted == "marker").when(kind == "markdown", F.lit(False)).otherwise(F.lit(True))
    return F.when(layout, wanted).otherwise(_lookup(kind, NATIVE_ENGINES))


def hashed(files: DataFrame, contents: DataFrame) -> DataFrame:
    """Files (id, sha256) without a hash get that of their ``contents`` (id, content); those without contents keep what they have."""
    legacy = F.coalesce("sha256", F.lit("")) == ""
    found = contents.select("id", F.sha2(F.col("content").cast("binary"), 256).alias("_found"))
    return files.join(found, "id", "left").withColumn("sha256", F.when(legacy & F.col("_found").isNotNull(), F.col("_found")).otherwise(F.col("sha256"))).drop("_found")


def measured(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ready files that lack chunk_count, engine or unit_count take them from their chunks (file_id, chunk_index,
    location_index, engine): the number, the first engine named, the highest place. The units of a PDF are its pages,
    where known. Other files, and those without chunks, stay as they are."""
    named = F.nullif(F.col("engine"), F.lit(""))
    told = chunks.groupBy(F.col("file_id").alias("id")).agg(
        F.count(F.lit(1)).alias("_chunks"),
        F.coalesce(F.max("location_index"), F.lit(0)).cast("long").alias("_units"),
        F.min(F.when(named.isNotNull(), F.struct("chunk_index", named.alias("engine")))).alias("_first"),
    )
    filled = lambda c: F.coalesce(F.col(c), F.lit(0)) != 0
    lacking = (F.col("status") == "ready") & F.col("_chunks").isNotNull() & ((F.col("chunk_count") == 0) | F.col("engine").isNull() | (F.col("unit_count") == 0))
    pages = (F.col("document_type") == "pdf") & filled("page_count")
    units = F.when(pages, F.col("page_count")).when(filled("unit_count"), F.col("unit_count")).otherwise(F.col("_units"))
    new = {"chunk_count": F.col("_chunks"), "unit_count": units, "engine": F.coalesce(named, "_first.engine")}
    return files.join(told, "id", "left").withColumns({c: F.when(lacking, v).otherwise(F.col(c)) for c, v in new.items()}).drop("_chunks", "_units", "_first")


def estimates(size: Column, name: Column) -> dict[str, Column]:
    """Pages (PDF only), seconds and disk bytes before an import; halves round to even."""
    pdf = F.lower(name).endswith(".pdf")
    seconds = F.bround(size / (1024 * 1024) * F.when(pdf, 2.2).otherwise(0.7), 0)
    return {
        "pages": F.when(pdf, F.greatest(F.lit(1), F.bround(size / (350 * 1024), 0)).cast("long")),
        "seconds": F.greatest(F.lit(2), seconds).cast("long"),
        "disk_bytes": F.greatest(size, F.floor(size * 1.35)).cast("long"),
    }


def registered(files: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Adds outcome and canonical id by content. ``files`` has id, status and the ``key`` of equal content: the first
    ready row of a key is reused by those after it; rows beside one that is in progress conflict; the rest are new.

    Only minima are gathered by key, so a key with very many copies is pre-aggregated."""
    first = F.struct(*(c for c in order if c != "id"), "id")
    ready = F.min(F.when(F.col("status") == "ready", first))
    busy = F.min(F.when(F.col("status").isin("uploaded", "parsing", "indexing"), first))
    best = files.groupBy(*key).agg(ready.alias("ready"), busy.alias("busy"), F.count(F.lit(1)).cast("long").alias("copies"))
    joined = files.join(cut(best, "registered"), key)  # apart from its counting, so that the join can split a hot key
    outcome = (
        F.when(F.col("ready").isNotNull() & (F.col("ready.id") != F.col("id")), "reuse")
        .when(F.col("ready").isNull() & F.col("busy").isNotNull() & (F.col("busy.id") != F.col("id")), "conflict")
        .otherwise("new")
    )
    return joined.withColumns({"outcome": outcome, "canonical_id": F.coalesce("ready.id", "busy.id", "id")}).drop("ready", "busy")


def best_version(files: DataFrame, name_key: str, most: int = 8) -> DataFrame:
    """Adds version_rank: the newest first; ``most`` a name. Spark limits each group before sorting it."""
    order = Window.partitionBy(name_key).orderBy(F.desc("updated"), "id")
    return files.withColumn("version_rank", F.row_number().over(order).cast("long")).where(F.col("version_rank") <= most)
