"""Text expressions: stripping, tokens, headings, chunks, previews. All JVM-side but for ``nfkc``."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Token and heading patterns, the default section name, chunk sizes.
TOKEN = r"[a-z0-9]+(?:[._+/-][a-z0-9]+)*|[㐀-鿿]+"
CJK_RUN = r"^[㐀-鿿]+$"
MARKDOWN_HEADING = r"^\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$"
NUMBERED_HEADING = r"^\s*(?:第[一二三四五六七八九十百千万0-9]+[章节部分]|(?:[一二三四五六七八九十]+|[0-9]+(?:\.[0-9]+){0,3})[、．.])\s*(.{1,160})$"
BODY = "正文"
CHUNK_SIZE, CHUNK_STEP = 500, 450
PREVIEW_CHARS = 300_000


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility normalisation, for which Spark has no built-in function."""
    return s.map(lambda t: unicodedata.normalize("NFKC", t or ""))


def compatible(text: Column) -> Column:
    """NFKC of the text. ASCII is its own, and only texts beyond it that are not yet normal reach Python."""
    filled = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(filled) == F.length(filled), filled).otherwise(nfkc(F.when(F.octet_length(filled) > F.length(filled), filled)))


def _cjk_tokens(run: Column) -> Column:
    single = F.split(run, "")
    pairs = F.transform(single, lambda c, i: F.concat(c, F.coalesce(F.get(single, i + 1), F.lit(""))))
    return F.concat(single, F.slice(pairs, 1, F.greatest(F.size(single) - 1, F.lit(0))))


def tokens(text: Column) -> Column:
    """Normalised (NFKC), lower-cased Latin words and digits, joined by ``._+/-``; CJK runs as characters, then as pairs."""
    runs = F.regexp_extract_all(F.lower(compatible(text)), F.lit(TOKEN), F.lit(0))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(CJK_RUN), _cjk_tokens(r)).otherwise(F.array(r))))


def key_tokens(all_tokens: Column) -> Column:
    """Distinct tokens longer than one character, or all distinct ones if there are none."""
    long = F.array_distinct(F.filter(all_tokens, lambda t: F.length(t) > 1))
    return F.when(F.size(long) > 0, long).otherwise(F.array_distinct(all_tokens))


def coverage(query_tokens: Column, text_tokens: Column) -> Column:
    wanted = key_tokens(query_tokens)
    return F.when(F.size(wanted) == 0, 0.0).otherwise(F.size(F.array_intersect(wanted, text_tokens)) / F.size(wanted))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def section_title(line: Column) -> Column:
    """The title a line sets, or null: the heading's text, or a whole numbered line."""
    clean = strip(line)
    return F.when(clean.rlike(MARKDOWN_HEADING), strip(F.regexp_extract(clean, MARKDOWN_HEADING, 1))).when(clean.rlike(NUMBERED_HEADING), clean)


def chunk_starts(text: Column, step: int = CHUNK_STEP) -> Column:
    """Offsets of the chunk windows of a text; none for an empty one."""
    return F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


def window(text: Column, start: Column, size: int = CHUNK_SIZE) -> Column:
    return F.substring(text, start + 1, F.lit(size))


def rerank_windows(text: Column, size: int = 360) -> Column:
    """The whole stripped text if short (null is empty), else its distinct start, middle and end windows in order of place.
    The stripped text is the variable of a lambda, so it is made once and not for each window."""

    def windows(whole: Column) -> Column:
        middle = F.floor(F.length(whole) / 2).cast("int") - size // 2
        starts = F.array_sort(F.array_distinct(F.array(F.lit(0), F.greatest(F.lit(0), middle), F.greatest(F.lit(0), F.length(whole) - size))))
        return F.when(F.length(whole) <= size, F.array(whole)).otherwise(F.transform(starts, lambda s: F.substring(whole, s + 1, F.lit(size))))

    return F.flatten(F.transform(F.array(strip(F.coalesce(text, F.lit("")))), windows))


def table_markdown(rows: Column) -> Column:
    """array<array<string>> -> Markdown table: blanks collapsed, empty rows dropped, rows padded to the widest."""
    clean = F.transform(rows, lambda r: F.transform(r, lambda c: strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))))
    used = F.filter(clean, lambda r: F.exists(r, lambda c: c != ""))
    width = F.array_max(F.transform(used, lambda r: F.size(r)))
    padded = F.transform(used, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    lines = F.transform(padded, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |")))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.when(F.size(used) == 0, "").otherwise(F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.size(lines))), "\n"))


def strip_code_fence(text: Column) -> Column:
    return strip(F.regexp_replace(strip(text), r"^```[A-Za-z0-9+#-]*[ \t]*\n?|\n?```$", ""))


def preview(text: Column) -> Column:
    return F.substring(text, 1, PREVIEW_CHARS)


def bytes_label(size: Column) -> Column:
    return (
        F.when(size.isNull() | (size <= 0), "0 B")
        .when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, F.format_string("%.1f KB", size / 1024))
        .otherwise(F.format_string("%.1f MB", size / (1024 * 1024)))
    )
