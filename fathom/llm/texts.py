"""Column expressions shared by the text operators. Every expression treats a null text as empty."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that splits words and strips lines.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def filled(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z only. A text without multi-byte characters may take the much faster ``lower``."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def twin_hash(*cols: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes with unlike seeds: together wide enough for trillions of keys."""
    return F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)
