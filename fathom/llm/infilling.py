"""Fill-in-the-middle: texts cut at token borders into prefix, middle and suffix, and put in the order of a form.

The borders of a text (code points at which a token ends) are kept as a set of containers of 65,536 positions each, the
smallest of three kinds: a sorted array, a bitmap, or runs. Containers carry the number of borders before them, so the
k-th border is found by a search over the containers and a select within one, without walking the text. The set is a
binary column (``borders``): a later epoch draws other cuts of the same text from it. Only building and selecting run
in Python, a batch at a time; drawing, cutting, ordering and restoring are column expressions.

Defined cases: a null text is empty; an empty text has no tokens and stays plain, as do texts that hold a marker; a null
id is drawn as an empty id; rows of equal id are drawn alike, whatever their text; repeated rows and an empty table
need no care; extra columns are kept, but for those named as the columns that are made, which give way.
"""

from __future__ import annotations

import struct
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm.texts import filled

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
SHARE = 50  # percent of the texts that are cut
SPM_SHARE = 80  # percent of those in the order suffix, prefix, middle
ARRAY, BITMAP, RUNS = 0, 1, 2
_SPAN, _WORDS = 1 << 16, 1 << 10
_HEAD = struct.Struct("<IBIII")  # key, kind, members up to and with this container, offset and bytes of its data


def token_ends(text: str) -> np.ndarray:
    """Where tokens end: words with the blanks before them, and blanks at the end."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
    ends = np.flatnonzero(~blank & np.append(blank[1:], True)) + 1
    return np.append(ends, len(codes)) if len(codes) and blank[-1] else ends


class BoundarySet:
    """A sorted set of positions. Its form in bytes is the form in memory: containers are read where they lie."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        (count,) = struct.unpack_from("<I", data)
        self.heads = [_HEAD.unpack_from(data, 4 + i * _HEAD.size) for i in range(count)]
        self.totals = [h[2] for h in self.heads]

    @classmethod
    def of(cls, positions: np.ndarray) -> BoundarySet:
        """``positions``: distinct and rising, below 2^32."""
        keys = positions >> 16
        starts = np.flatnonzero(np.diff(keys, prepend=-1))
        heads, parts, at, before = [], [], 0, 0
        for start, end in zip(starts, np.append(starts, len(positions))[1:], strict=True):
            kind, body = cls._container((positions[start:end] & (_SPAN - 1)).astype(np.uint32))
            before += int(end - start)
            heads.append(_HEAD.pack(int(keys[start]), kind, before, at, len(body)))
            parts.append(body)
            at += len(body)
        return cls(struct.pack("<I", len(heads)) + b"".join(heads) + b"".join(parts))

    @staticmethod
    def _container(low: np.ndarray) -> tuple[int, bytes]:
        begins = np.flatnonzero(np.diff(low.astype(np.int64), prepend=-2) != 1)
        sizes = {ARRAY: 2 * len(low), BITMAP: 8 * _WORDS, RUNS: 6 * len(begins)}
        kind = min(sizes, key=lambda k: (sizes[k], k))
        if kind == ARRAY:
            return kind, low.astype("<u2").tobytes()
        if kind == BITMAP:
            bits = np.zeros(_SPAN, np.uint8)
            bits[low] = 1
            return kind, np.packbits(bits, bitorder="little").tobytes()
        lengths = np.diff(np.append(begins, len(low)))
        return kind, low[begins].astype("<u2").tobytes() + np.cumsum(lengths).astype("<u4").tobytes()

    def __len__(self) -> int:
        return self.totals[-1] if self.totals else 0

    def select(self, k: int) -> int:
        """The k-th smallest position, from 0."""
        c = bisect_left(self.totals, k + 1)
        key, kind, _, offset, size = self.heads[c]
        k -= self.totals[c - 1] if c else 0
        offset += 4 + len(self.heads) * _HEAD.size
        if kind == ARRAY:
            low = int(np.frombuffer(self.data, "<u2", 1, offset + 2 * k)[0])
        elif kind == BITMAP:
            words = np.frombuffer(self.data, "<u8", _WORDS, offset)
            ranks = np.cumsum(np.bitwise_count(words), dtype=np.int64)
            w = int(np.searchsorted(ranks, k + 1))
            bits = np.unpackbits(words[w : w + 1].view(np.uint8), bitorder="little")
            low = 64 * w + int(np.flatnonzero(bits)[k - (int(ranks[w - 1]) if w else 0)])
        else:
            n = size // 6
            ranks = np.frombuffer(self.data, "<u4", n, offset + 2 * n)
            r = int(np.searchsorted(ranks, k + 1))
            low = int(np.frombuffer(self.data, "<u2", 1, offset + 2 * r)[0]) + k - (int(ranks[r - 1]) if r else 0)
        return (key << 16) + low


@F.pandas_udf(T.BinaryType())
def borders(texts: pd.Series) -> pd.Series:
    """The set of token borders of each text, in bytes; null is an empty text."""
    return texts.map(lambda t: BoundarySet.of(token_ends(t or "")).data)


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("n", "first", "last")]))
def cuts(sets: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Tokens of the text, and the code points before the smaller and the larger of a and b, each modulo tokens + 1."""
    found = []
    for data, x, y in zip(sets, a, b, strict=True):
        own = BoundarySet(data)
        n = len(own)
        low, high = sorted((int(x) % (n + 1), int(y) % (n + 1)))
        found.append((n, own.select(low - 1) if low else 0, own.select(high - 1) if high else 0))
    return pd.DataFrame(found, columns=["n", "first", "last"])


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four 32-bit numbers of an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def joined(form: Column, text: Column, prefix: Column, middle: Column, suffix: Column) -> Column:
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    return F.when(form == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(form == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(text)


def restored(output: Column, form: Column) -> Column:
    """The text, from an output and its form alone. Parts hold no marker, and no marker begins inside another."""
    after = lambda c, mark: F.substring(c, F.locate(mark, c) + len(mark), F.length(c))
    until = lambda c, mark: F.substring_index(c, mark, 1)
    middle = after(output, MIDDLE)
    last = F.when(form == "psm", until(after(output, SUFFIX), MIDDLE)).otherwise(until(after(output, SUFFIX), PREFIX))
    first = F.when(form == "psm", until(after(output, PREFIX), SUFFIX)).otherwise(until(after(output, PREFIX), MIDDLE))
    return F.when(form == "plain", output).otherwise(F.concat(first, middle, last))


def transform(docs: DataFrame, seed: int = SEED, share: int = SHARE, spm_share: int = SPM_SHARE) -> DataFrame:
    """All rows and columns, with n (tokens), form (plain, psm, spm), prefix_chars and middle_chars (null if plain) and
    output. Without a column ``borders`` the sets are built on the way."""
    made = ("n", "form", "prefix_chars", "middle_chars", "output")
    held = [c for c in docs.columns if c not in (*made, "borders")]
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    sets = F.col("borders") if "borders" in docs.columns else borders("text")
    text = filled("text")
    plain = (text == "") | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE)) | (h3 % 100 >= share)
    form = F.when(plain, "plain").when(h4 % 100 < spm_share, "spm").otherwise("psm")
    found = docs.select(*held, form.alias("form"), cuts(sets, h1, h2).alias("_cut"))
    first, last, cut_up = F.col("_cut.first"), F.col("_cut.last"), F.col("form") != "plain"
    part = lambda start, length: F.substring(text, start.cast("int") + 1, length.cast("int"))
    whole = joined(F.col("form"), text, part(F.lit(0), first), part(first, last - first), F.substring(text, last.cast("int") + 1, F.length(text)))
    return found.select(
        *held, F.col("_cut.n").alias("n"), "form", F.when(cut_up, first).alias("prefix_chars"), F.when(cut_up, last - first).alias("middle_chars"), whole.alias("output")
    )
