"""DOCX and PPTX by the standard library's zip and XML readers, one file at a time inside an Arrow batch."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# XML name spaces, required members, archive limits.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
REQUIRED = {"docx": ("[Content_Types].xml", "word/document.xml"), "pptx": ("[Content_Types].xml", "ppt/presentation.xml")}
MOST_MEMBERS, MOST_UNPACKED, MOST_RATIO = 10_000, 300 * 1024 * 1024, 250
BODY = "正文"


def check_archive(kind: str | None, data: bytes | None) -> str | None:
    """Why an office archive is refused, or null."""
    if kind not in REQUIRED:
        return None
    try:
        members = zipfile.ZipFile(io.BytesIO(data or b"")).infolist()
    except zipfile.BadZipFile:
        return "no archive"
    names = {m.filename for m in members}
    unpacked, packed = sum(m.file_size for m in members), sum(m.compress_size for m in members)
    if len(members) > MOST_MEMBERS:
        return "too many members"
    if not names.issuperset(REQUIRED[kind]):
        return "missing member"
    if any(PurePosixPath(n).is_absolute() or ".." in PurePosixPath(n.replace("\\", "/")).parts for n in names):
        return "unsafe path"
    if any(m.flag_bits & 1 for m in members):
        return "encrypted"
    if unpacked > MOST_UNPACKED:
        return "too large unpacked"
    return "suspicious ratio" if unpacked > MOST_RATIO * max(1, packed) else None


def archive_problem(kind: Column, content: Column) -> Column:
    run = F.pandas_udf(lambda k, c: pd.Series([check_archive(x, y) for x, y in zip(k, c, strict=True)], dtype="object"), T.StringType())
    return run(kind, content)


def table_text(rows: list[list[str]]) -> str:
    clean = [[re.sub(r"\s+", " ", c).strip() for c in r] for r in rows]
    clean = [r for r in clean if any(r)]
    width = max(map(len, clean), default=0)
    lines = [f"| {' | '.join(r + [''] * (width - len(r)))} |" for r in clean]
    return "\n".join([*lines[:1], *([f"| {' | '.join(['---'] * width)} |"] if lines else []), *lines[1:]])


def _text(node: ET.Element, tag: str) -> str:
    return "".join(t.text or "" for t in node.iter(tag))


def docx_segments(data: bytes) -> list[tuple[str, int, str, str]]:
    """Sections in the order of the body; paragraphs of a heading style open one."""
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{W}body")
    sections: list[tuple[str, list[str]]] = [(BODY, [])]
    for node in body if body is not None else []:
        if node.tag == f"{W}p":
            text = _text(node, f"{W}t").strip()
            style = node.find(f"{W}pPr/{W}pStyle")
            named = (style.get(f"{W}val") or "").lower() if style is not None else ""
            if text and (named.startswith("heading") or "标题" in named):
                sections.append((text[:180], [text]))
            elif text:
                sections[-1][1].append(text)
        elif node.tag == f"{W}tbl":
            made = table_text([[_text(c, f"{W}t") for c in r.findall(f"{W}tc")] for r in node.findall(f"{W}tr")])
            if made:
                sections[-1][1].append(made)
    return [("heading", i + 1, s, "\n".join(parts)) for i, (s, parts) in enumerate((s, p) for s, p in sections if p)]


def _place(shape: ET.Element) -> tuple[int, int]:
    at = next(shape.iter(f"{A}off"), None)
    return (int(at.get("y", 0)), int(at.get("x", 0))) if at is not None else (0, 0)


def pptx_segments(data: bytes) -> list[tuple[str, int, str, str]]:
    """One segment a slide: shapes from top to bottom and left to right, tables, notes; repeated parts once."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    names = set(archive.namelist())
    slides = sorted((int(m[1]), n) for n in names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    out = []
    for number, name in slides:
        tree = ET.fromstring(archive.read(name)).find(f"{P}cSld/{P}spTree")
        parts = []
        for shape in sorted(tree if tree is not None else [], key=_place):
            if (grid := next(shape.iter(f"{A}tbl"), None)) is not None:
                parts.append(table_text([[_text(c, f"{A}t") for c in r.findall(f"{A}tc")] for r in grid.findall(f"{A}tr")]))
            else:
                parts += [t for p in shape.iter(f"{A}p") if (t := _text(p, f"{A}t").strip())]
        notes = f"ppt/notesSlides/notesSlide{number}.xml"
        if notes in names:
            parts += [t for p in ET.fromstring(archive.read(notes)).iter(f"{A}p") if (t := _text(p, f"{A}t").strip())]
        parts = list(dict.fromkeys(p for p in parts if p))
        if parts:
            out.append(("slide", number, parts[0][:180], "\n".join(parts)))
    return out


def segments(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, location_type, location_index, section, text of files with document_type and content."""
    fields = ["location_type", "location_index", "section", "text"]

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for kinds, contents in batches:
            made = [docx_segments(c) if k == "docx" else pptx_segments(c) for k, c in zip(kinds, contents, strict=True)]
            yield pd.Series([[dict(zip(fields, s, strict=True)) for s in m] for m in made])

    parse = F.pandas_udf(run, "array<struct<location_type:string,location_index:bigint,section:string,text:string>>")
    return files.select(*keys, F.explode(parse("document_type", "content")).alias("s")).select(*keys, "s.*")
