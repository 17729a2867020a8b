"""HTML pages to located sections, with the standard library's parser inside an Arrow batch."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements that are dropped, that split, and that hold text.
UNSAFE = ("script", "style", "iframe", "object", "embed", "form", "noscript")
CHROME = ("nav", "header", "footer", "aside")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCKS = ("p", "li", "pre", "blockquote")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
ROOTS = ("article", "main", "body")
BODY = "正文"


def _clean(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


class _Outline(HTMLParser):
    """Collects (root, kind, text) of headings, blocks and table rows outside dropped elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.blocked = 0
        self.items: list[tuple[frozenset, str, str]] = []
        self.loose: list[tuple[frozenset, str]] = []
        self.held: list[tuple[str, list[str]]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            if tag == "br" and self.held:
                self.held[-1][1].append(" ")
            return
        self.open.append(tag)
        self.blocked += tag in UNSAFE or tag in CHROME
        if not self.blocked and (tag in HEADINGS or tag in BLOCKS or tag == "tr"):
            self.held.append((tag, []))
        elif not self.blocked and tag in ("td", "th") and self.held and self.held[-1][0] == "tr" and self.held[-1][1]:
            self.held[-1][1].append(" | ")

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.open:
            return
        while self.open:
            top = self.open.pop()
            self.blocked -= top in UNSAFE or top in CHROME
            if self.held and self.held[-1][0] == top and not self.blocked:
                kind, parts = self.held.pop()
                text = _clean("".join(parts))
                if text:
                    self.items.append((frozenset(self.open), kind, text))
                if self.held and self.held[-1][0] in BLOCKS and kind in BLOCKS:
                    self.held[-1][1].append(" ")
            if top == tag:
                return

    def handle_data(self, data: str) -> None:
        if self.blocked:
            return
        if self.held:
            self.held[-1][1].append(data)
        self.loose.append((frozenset(self.open), data))


def page_segments(html: str | None) -> list[tuple[int, str, str]]:
    """(location_index, section, text): headings split, repeated text within a section goes, and a page without
    blocks is one section of all its text."""
    outline = _Outline()
    outline.feed(html or "")
    outline.close()
    tags = {t for at, *_ in outline.loose for t in at}
    root = next((r for r in ROOTS if r in tags), None)
    inside = lambda at: root is None or root in at
    found: list[tuple[str, list[str]]] = [(BODY, [])]
    for at, kind, text in outline.items:
        if not inside(at):
            continue
        if kind in HEADINGS:
            found.append((text[:180], [text]))
        elif text not in found[-1][1]:
            found[-1][1].append(text)
    made = [(section, "\n".join(parts)) for section, parts in found if parts]
    if not any(kind not in HEADINGS for _, kind, _ in outline.items):
        whole = _clean(" ".join(text for at, text in outline.loose if inside(at)))
        made = [(BODY, whole)] if whole and not made else made
    return [(i + 1, s, t) for i, (s, t) in enumerate(made)]


class _Sanitizer(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.skip: list[str] = []

    def _tag(self, tag: str, attrs: list, end: str) -> None:
        kept = [
            (k, v) for k, v in attrs
            if not k.startswith("on") and k not in ("srcdoc", "integrity") and not re.match(r"\s*(javascript|data):", v or "", re.I)
        ]
        self.out.append(f"<{tag}{''.join(f' {k}' if v is None else f' {k}="{v}"' for k, v in kept)}{end}")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in UNSAFE and tag not in VOID:
            self.skip.append(tag)
        elif not self.skip and tag not in UNSAFE:
            self._tag(tag, attrs, ">")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if not self.skip and tag not in UNSAFE:
            self._tag(tag, attrs, "/>")

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
        elif tag not in UNSAFE:
            self.out.append(f"</{tag}>")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(data)

    def handle_entityref(self, name: str) -> None:
        self.handle_data(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self.handle_data(f"&#{name};")


def sanitize(html: str | None) -> str:
    parser = _Sanitizer()
    parser.feed(html or "")
    parser.close()
    return "".join(parser.out)


def segments(pages: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, location_index, section, text, one row a section."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([[{"location_index": i, "section": x, "text": t} for i, x, t in page_segments(h)] for h in s])

    parsed = F.pandas_udf(run, "array<struct<location_index:bigint,section:string,text:string>>")
    return pages.select(*keys, F.explode(parsed(F.col(column))).alias("s")).select(*keys, "s.*")
