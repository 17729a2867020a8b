"""Main text of web pages: flat text blocks, told apart by a decision tree.

A page becomes a flat list of blocks, each with its words, the share of them inside links, and what its open elements
say of it (``FEATURES``). A small scanner does that, a page at a time, in Arrow batches. The rest are column
expressions within the row: each block gets the words and link density of the block before and after it, a decision
tree keeps it or not, and the kept blocks are joined. The tree is grown on a small labelled table (``examples.pages``
unless another is given) of whole pages in which the blocks of main text are marked.

Defined cases: null and empty html give an empty text, and so does a page without a kept block; broken markup is read
as far as it goes: elements left open end with those around them, comments, scripts and tags without an end reach to the
end of the page, a ``<`` that opens nothing is text; white space is what Unicode calls so, no-break spaces included;
null and repeated ids are rows like others; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm import examples

# Words of the block and their linked share; open elements that hold no main text by name, class, id or role, inside the
# outermost element that holds it (inner) and around that (outer); whether one that holds it is open (main); heading
# 1 to 6, else 0; whether a header is open; whether the page has an element that holds main text (marked).
FEATURES = ("words", "linked", "inner", "outer", "main", "heading", "header", "marked")
NEIGHBOURS = ("words", "linked")
BLOCK = T.StructType([T.StructField("text", T.StringType()), *(T.StructField(f, T.DoubleType() if f == "linked" else T.IntegerType()) for f in FEATURES)])
DEPTH, LEAST = 8, 5  # of the tree; examples in a leaf

HIDDEN = ("script", "style", "noscript", "template", "svg", "math", "title", "iframe", "object", "canvas")
INLINE = (
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q",
    "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "nobr", "label",
)
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
BOILER_TAGS = ("nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "textarea", "fieldset")
MAIN_TAGS = ("article", "main")
BOILER_ROLES = ("navigation", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alert", "alertdialog", "form", "toolbar")
BOILER_WORDS = (
    "ad", "ads", "adbox", "adslot", "advert", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "sidebar", "aside",
    "nav", "navbar", "navigation", "menu", "submenu", "breadcrumb", "breadcrumbs", "footer", "cookie", "cookies", "consent", "gdpr", "notice", "notification",
    "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "comment", "comments", "commentlist", "disqus", "reply", "replies",
    "respond", "discussion", "share", "sharing", "social", "related", "recommended", "recommendations", "widget", "toolbar", "pagination", "pager", "copyright", "legal",
    "disclaimer", "skip", "search", "alert", "paywall", "hidden", "outbrain", "taboola", "trending", "toplist",
)
HEADER_WORDS = ("header", "masthead", "topbar", "byline", "meta", "dateline")
MAIN_WORDS = ("article", "articlebody", "post", "entry", "story", "content", "main", "maincontent", "posttext", "bodytext")

_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([A-Za-z][^\s/<>]*))")
_ENDS = {name: re.compile(f"</{name}", re.IGNORECASE) for name in HIDDEN}
_NAMED = re.compile(r"""(class|id|role|itemprop|style|hidden|aria-hidden)(?=[\s=>/]|$)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_TOLD = re.compile(r"class|id|role|itemprop|style|hidden", re.IGNORECASE)
_TOKENS = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


@dataclass
class _Element:
    name: str
    boiler: bool = False
    main: bool = False
    header: bool = False


def element(name: str, attributes: str) -> _Element:
    """What an element says of the text inside, by its name and attributes."""
    found = _Element(name, name in BOILER_TAGS, name in MAIN_TAGS, name == "header")
    if not attributes or not _TOLD.search(attributes):
        return found
    told: set[str] = set()
    for key, value in _NAMED.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            for part in value.split():
                told |= {t.lower() for t in _TOKENS.findall(part)} | {re.sub(r"[^a-z]", "", part.lower())}
        elif key == "role":
            found.boiler |= value.lower() in BOILER_ROLES
            found.header |= value.lower() == "banner"
            found.main |= value.lower() in ("main", "article")
        elif key == "itemprop":
            found.main |= value.lower() == "articlebody"
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _HIDING.search(value)):
            found.boiler = True
    if name not in ("html", "body"):
        found.boiler |= not told.isdisjoint(BOILER_WORDS)
        found.header |= not told.isdisjoint(HEADER_WORDS)
        found.main |= not found.boiler and not found.header and name not in INLINE and not told.isdisjoint(MAIN_WORDS)
    return found


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", name, attributes), ("close", name, "") in order. Comments and hidden elements are
    passed over. Every search starts where the last one ended, so the work grows with the length of the page."""
    at, size = 0, len(page)
    start = 0  # of the text not yet told
    quotes = {'"': True, "'": True}  # whether one may still follow
    while at < size:
        hit = _OPEN.search(page, at)
        if not hit:
            break
        begin, name = hit.start(), (hit[2] or "").lower()
        if start < begin:
            yield "text", page[start:begin], ""
        if not name:
            mark = "-->" if hit[0] == "<!--" else ">"
            end = page.find(mark, hit.end())
            at = start = size if end < 0 else end + len(mark)
            continue
        end = hit.end()
        while True:  # quoted values may hold >
            close = page.find(">", end)
            if close < 0:
                at = start = size
                break
            if page.count('"', end, close) % 2 == page.count("'", end, close) % 2 == 0:
                at = start = close + 1
                break
            quote = min((p for q, alive in quotes.items() if alive and (p := page.find(q, end, close)) >= 0), default=-1)
            if quote < 0 or not page[end:quote].rstrip().endswith("="):
                at = start = close + 1
                break
            after = page.find(page[quote], quote + 1)
            if after < 0:
                quotes[page[quote]] = False
                continue
            end = after + 1
        if close < 0:
            return
        if hit[1]:
            yield "close", name, ""
            continue
        yield "open", name, page[hit.end() : close]
        if name in HIDDEN and not (name in ("svg", "math", "object") and page[close - 1] == "/"):
            end = _ENDS[name].search(page, at)
            at = start = end.start() if end else size
    if start < size:
        yield "text", page[start:], ""


def blocks(page: str | None) -> list[tuple]:
    """The blocks of a page that hold text, in order, as tuples of ``BLOCK``."""
    stack: list[tuple[str, tuple[int, ...]]] = []  # open elements: name and inner, outer, main, heading, header within
    open_ = Counter()
    found: list[list] = []
    parts: list[str] = []
    counts = [0, 0]  # words, linked words
    joined = False  # whether the last text ended within a word

    def state() -> tuple[int, ...]:
        return stack[-1][1] if stack else (0, 0, 0, 0, 0)

    def enter(e: _Element) -> None:
        inner, outer, main, heading, header = state()
        inner, outer = (e.boiler, inner + outer) if e.main else (inner + e.boiler, outer)
        heading = int(e.name[1]) if len(e.name) == 2 and e.name[0] == "h" and e.name[1] in "123456" else heading
        stack.append((e.name, (int(inner), outer, int(main or e.main), heading, int(header or e.header))))
        open_[e.name] += 1

    def leave(name: str) -> None:
        while open_[name]:
            gone = stack.pop()[0]
            open_[gone] -= 1
            if gone == name:
                break

    def flush() -> None:
        nonlocal joined
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            n = max(1, counts[0])
            found.append([text, len(text.split()), min(1.0, counts[1] / n), *state()])
        parts.clear()
        counts[:] = 0, 0
        joined = False

    for kind, what, attributes in tokens(page or ""):
        if kind == "text":
            parts.append(what)
            n = len(what.split())
            if n:
                own = n - (joined and not what[0].isspace())
                counts[0] += own
                counts[1] += min(n, max(own, 1)) if open_["a"] else 0
                joined = not what[-1].isspace()
            else:
                joined = False
            continue
        if what in HIDDEN:
            continue
        if what in ("br", "hr", "wbr"):
            if what != "wbr":
                parts.append(" ")
                joined = False
            continue
        if what not in INLINE:
            flush()
        if kind == "close":
            leave(what)
        elif what not in VOID:
            if what not in INLINE and open_["p"]:
                leave("p")  # a paragraph ends where another block begins
            if what in ("a", "option"):
                leave(what)
            enter(element(what, attributes))
    flush()
    marked = int(any(f[5] for f in found))
    return [(*f, marked) for f in found]


# --- the tree --------------------------------------------------------------------------------------------------


@dataclass
class Node:
    keep: bool
    feature: str = ""
    most: float = 0.0  # goes left up to it
    left: Node | None = None
    right: Node | None = None


def described(found: list[tuple]) -> list[dict[str, float]]:
    """Features of the blocks of one page, neighbours included; there is nothing before the first and after the last."""
    own = [dict(zip(FEATURES, b[1:], strict=True)) for b in found]
    none = dict.fromkeys(NEIGHBOURS, 0)
    for i, b in enumerate(own):
        before, after = own[i - 1] if i else none, own[i + 1] if i + 1 < len(own) else none
        b |= {f"before_{f}": before[f] for f in NEIGHBOURS} | {f"after_{f}": after[f] for f in NEIGHBOURS}
    return own


def grow(rows: list[tuple[dict[str, float], bool]], depth: int = DEPTH, least: int = LEAST) -> Node:
    """A binary tree of least Gini impurity; ties go to the feature and limit that come first."""
    kept = sum(y for _, y in rows)
    here = Node(2 * kept > len(rows))
    if not depth or kept in (0, len(rows)):
        return here
    impurity = lambda n, k: 2 * k * (n - k) / n if n else 0.0
    best = impurity(len(rows), kept) - 1e-9, None, 0.0
    for name in rows[0][0]:
        ordered = sorted((x[name], y) for x, y in rows)
        k = 0
        for i, (value, y) in enumerate(ordered[:-1], 1):
            k += y
            if value == ordered[i][0] or i < least or len(rows) - i < least:
                continue
            cost = impurity(i, k) + impurity(len(rows) - i, kept - k)
            if cost < best[0] - 1e-12:
                best = cost, name, (value + ordered[i][0]) / 2
    if best[1] is None:
        return here
    left, right = (grow([r for r in rows if (r[0][best[1]] <= best[2]) == side], depth - 1, least) for side in (True, False))
    if left.left is None and right.left is None and left.keep == right.keep:
        return here
    here.feature, here.most, here.left, here.right = best[1], best[2], left, right
    return here


def train(pages: list[str] | None = None) -> Node:
    """``pages``: whole pages, small in number (by default those of ``examples``); a block is main text if it holds the mark ``examples.MARK``."""
    rows = []
    for page in examples.pages() if pages is None else pages:
        found = blocks(page)
        rows += [(x, examples.MARK in b[0]) for x, b in zip(described(found), found, strict=True)]
    return grow(rows)


def decided(node: Node, feature: dict[str, Column]) -> Column:
    """The tree as an expression."""
    if node.left is None:
        return F.lit(node.keep)
    return F.when(feature[node.feature] <= node.most, decided(node.left, feature)).otherwise(decided(node.right, feature))


@F.pandas_udf(T.ArrayType(BLOCK))
def scanned(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: [dict(zip(BLOCK.names, b, strict=True)) for b in blocks(p)])


def extract(pages: DataFrame, tree: Node | None = None, column: str = "html") -> DataFrame:
    """All rows and columns but ``column``, with text: the kept blocks, joined by one space."""
    tree = tree or train()
    held = [c for c in pages.columns if c not in (column, "text")]
    found = pages.select(*held, scanned(column).alias("_blocks"))

    def keep(b: Column, i: Column) -> Column:
        near = {"before": F.get("_blocks", i - 1), "after": F.get("_blocks", i + 1)}
        feature = {f: b[f] for f in FEATURES} | {f"{side}_{f}": F.coalesce(n[f], F.lit(0)) for side, n in near.items() for f in NEIGHBOURS}
        return decided(tree, feature)

    kept = F.transform(F.filter("_blocks", keep), lambda b: b["text"])
    return found.select(*held, F.array_join(kept, " ").alias("text"))


__all__ = ["Node", "blocks", "extract", "grow", "train"]
