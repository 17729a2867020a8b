"""Benchmark decontamination by template windows.

Texts become templates of one token a word: words with a digit are ``#n``, a unit after a number is ``#u``, a
capitalised word inside a sentence is ``#p``, one that opens a text, a sentence or a line is ``#o`` (a name or not, so
``Tom has 5 pears. Tom buys 4.`` meets ``Ann has 7 pears. Ann buys 9.``), all else is lower-cased and loses its punctuation. Windows of
``WINDOW`` template tokens of the documents are hash-joined with those of the benchmark, so a question whose numbers,
names or units were exchanged still meets its source. Windows with fewer than ``LITERAL`` words other than numbers, units
and names inside sentences say too little as templates: they must be met word for word (but for case). Hits line up by offset; along one offset each value of a slot in the
benchmark must stand for one value in the document and the other way round (slot consistency), else that offset does
not count. A document leaks an item if its counted windows cover ``COVERAGE`` of the item's template windows, or of all
its windows.

Items that share a stem do not multiply: to reach the coverage, a document must hold at least one of an item's rarest
windows (all but the number needed, plus one), so those alone name the candidates, and only candidates are expanded.

Short items are met as whole lines: an item of fewer than ``WINDOW`` words without a template window leaks where a line
of a document has the same template and its slots are consistent both ways; without any literal word, or any slot,
where a line is the item word for word (but for case). Openers stay words there, as a short item has few others. So ``What is 12 times 30?`` meets a line ``What is 7 times 45?``.

The benchmark side of the join is broadcast only where Spark knows its size to be under the session's threshold;
beyond it, both sides are shuffled by hash.

Defined cases: null and empty texts have no windows; items of fewer words than a window are one window of their own
length; equal benchmark texts are one item (the least id); rows of equal id and text are one document; empty tables
give an empty result; extra columns are ignored by ``leaks`` and kept by ``without_leaks``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.texts import filled, words
from fathom.session import cut

WINDOW = 8
LITERAL = 5
COVERAGE = 0.3
CONSISTENT = 0.8
SLOTS, OPENER = ("#n", "#p", "#u"), "#o"
# Units of measure that may follow a number.
UNITS = "mm cm m km mi in ft yd g kg mg lb lbs oz t l ml s sec min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years meter meters metre metres mile miles gram grams kilogram kilograms pound pounds liter liters litre litres dollar dollars euro euros cent cents percent degrees mph kmh km/h watt watts volt volts"
DOC = ["doc_id", "doc_hash"]


def keyed(docs: DataFrame) -> DataFrame:
    text = filled("text")
    return docs.select("doc_id", F.xxhash64("doc_id", text).alias("doc_hash"), text.alias("text"))


def template(text: Column, openers: bool = True) -> Column:
    """Template tokens, one for each word; without ``openers``, the words that open sentences stay words."""
    marks = r"[\p{P}\p{S}&&[^#]]+"
    out = F.regexp_replace(text, r"(?<!\S)\S*?[0-9]\S*", "#n")
    out = F.regexp_replace(out, r"(?<=[^\s.!?:;|][ \t])\p{Lu}\S*", "#p")
    if openers:
        out = F.regexp_replace(out, r"(?<!\S)[\p{P}\p{S}]*\p{Lu}\S*", "#o")
    out = F.lower(out)
    out = F.regexp_replace(out, rf"(?<=[\p{{L}}#]){marks}|{marks}(?=[\p{{L}}#])", "")
    out = F.regexp_replace(out, rf"(?<=#n )(?:{'|'.join(UNITS.split())})(?!\S)", "#u")
    return words(out)


def windows(hashes: Column, size: int = WINDOW) -> Column:
    """Hashes of all windows of ``size`` tokens; none if there are fewer tokens."""
    at = lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(size)))
    return F.when(F.size(hashes) >= size, F.transform(F.sequence(F.lit(0), F.size(hashes) - size), at)).otherwise(F.array().cast("array<bigint>"))


def _tokens(rows: DataFrame, *ids: str) -> DataFrame:
    return rows.select(*ids, template(F.col("text")).alias("tokens")).select(*ids, "tokens", F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes"))


def _plain(word: Column) -> Column:
    """Hash of a raw word, apart from those of template tokens."""
    return F.xxhash64(F.lit("word"), F.lower(word))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, ipos, size, hash, n_windows (of templates), n_all, exact, slots (places in the window), own (raw words of the window)."""
    items = benchmark.where("text is not null").groupBy("text").agg(F.min("item_id").alias("item_id"))
    raw = items.select("item_id", words(F.col("text")).alias("raw"))
    size = F.least(F.lit(WINDOW), F.size("tokens"))
    parts = [F.when(size == n, windows(F.col("hashes"), n)) for n in range(LITERAL, WINDOW + 1)]
    found = (
        _tokens(items, "item_id")
        .withColumn("size", size)
        .select("item_id", "tokens", "size", F.posexplode(F.coalesce(*parts)).alias("ipos", "hash"))
        .withColumn("inside", F.slice("tokens", F.col("ipos") + 1, F.col("size")))
        .withColumn("slots", F.filter(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.get("inside", i).isin(*SLOTS, OPENER)))
        .withColumn("exact", F.size(F.filter("inside", lambda t: ~t.isin(*SLOTS))) < LITERAL)
    )
    counted = found.groupBy("item_id").agg(F.count(F.when(~F.col("exact"), 1)).alias("n_windows"), F.count(F.lit(1)).alias("n_all"))
    own = F.slice("raw", F.col("ipos") + 1, F.col("size"))
    plain = F.transform(own, _plain)
    word_for_word = F.coalesce(*(F.when(F.col("size") == n, F.xxhash64(*(F.get(plain, F.lit(k)) for k in range(n)))) for n in range(LITERAL, WINDOW + 1)))
    return found.join(counted, "item_id").join(raw, "item_id").select(
        "item_id",
        "ipos",
        "size",
        F.when(F.col("exact"), word_for_word).otherwise(F.col("hash")).alias("hash"),
        "n_windows",
        "n_all",
        "exact",
        F.when(F.col("exact"), F.array().cast("array<int>")).otherwise(F.col("slots")).alias("slots"),
        own.alias("own"),
    )


def _bare(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", ""))


def _same_doc(left: str, right: str) -> Column:
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}.doc_hash") == F.col(f"{right}.doc_hash"))


def _slot_check(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """By document, item and offset: the share of the item's slot values that stand for one value in the document, or
    of the document's that stand for one of the item, whichever is less."""
    slotted = hits.where(F.size("slots") > 0)
    holders = cut(slotted.select(*DOC).distinct(), "slotted")
    raw = keyed(docs).alias("r").join(holders.alias("h"), _same_doc("r", "h"), "left_semi")
    raw = raw.select(*DOC, words(F.col("text")).alias("raw")).dropDuplicates(DOC)
    pair = F.transform("slots", lambda i: F.struct(_bare(F.get("own", i)).alias("item_value"), _bare(F.get("raw", F.col("pos") + i)).alias("doc_value")))
    key = [*DOC, "item_id", "offset"]
    pairs = slotted.alias("s").join(raw.alias("r"), _same_doc("s", "r")).select(*(F.col(f"s.{c}").alias(c) for c in key), F.explode(pair).alias("pair"))
    sides = F.array(F.struct(F.lit("item").alias("side"), F.col("pair.item_value").alias("one"), F.col("pair.doc_value").alias("other")), F.struct(F.lit("doc").alias("side"), F.col("pair.doc_value").alias("one"), F.col("pair.item_value").alias("other")))
    return (
        pairs.select(*key, F.explode(sides).alias("v"))
        .groupBy(*key, "v.side", "v.one")
        .agg((F.min("v.other") == F.max("v.other")).cast("double").alias("same"))
        .groupBy(*key, "side")
        .agg(F.avg("same").alias("same"))
        .groupBy(*key)
        .agg(F.min("same").alias("consistency"))
    )


def _with_rare(bench: DataFrame, coverage: float) -> DataFrame:
    """Adds ``rare``: whether a window is among those of which a leaking document must hold one."""
    spread = bench.groupBy("hash").agg(F.count_distinct("item_id").alias("n_items"))
    needed = F.when(F.col("n_windows") > 0, F.ceil(F.col("n_windows") * coverage - 1e-9)).otherwise(F.ceil(F.col("n_all") * coverage - 1e-9))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("n_items", "hash", "ipos"))  # windows of one item
    return bench.join(spread, "hash").withColumn("rare", place <= F.col("n_all") - F.greatest(needed, F.lit(1)) + 1).drop("n_items")


def _line_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, doc_hash, item_id, coverage, consistency of short items that are whole lines of documents."""
    items = benchmark.where("text is not null").groupBy("text").agg(F.min("item_id").alias("item_id"))
    items = items.select("item_id", words(F.col("text")).alias("own"), template(F.col("text"), openers=False).alias("tokens")).where(F.size("own").between(1, WINDOW - 1))
    is_slot = lambda t: t.isin(*SLOTS)
    literal = F.size(F.filter("tokens", lambda t: ~is_slot(t)))
    items = items.withColumn("literal", literal).where(F.col("literal") < LITERAL)
    as_template = (F.col("literal") > 0) & (F.col("literal") < F.size("tokens"))
    key = lambda own, tokens, whole: F.xxhash64(whole, F.when(whole, F.transform(own, F.lower)).otherwise(tokens))
    slots = F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: is_slot(F.get("tokens", i)))
    items = cut(items.select("item_id", "own", key(F.col("own"), F.col("tokens"), ~as_template).alias("hash"), F.when(as_template, slots).otherwise(F.array().cast("array<int>")).alias("slots")), "short-items")
    if items.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, doc_hash long, item_id long, coverage double, consistency double")
    lines = keyed(docs).select(*DOC, F.explode(F.split("text", "\n")).alias("line")).select(*DOC, "line", words(F.col("line")).alias("raw")).where(F.size("raw").between(1, WINDOW - 1))
    hashes = F.array(*(key(F.col("raw"), template(F.col("line"), openers=False), F.lit(whole)) for whole in (True, False)))
    met = lines.select(*DOC, "raw", F.explode(hashes).alias("hash")).join(items, "hash")
    pairs = F.array_distinct(F.transform("slots", lambda i: F.struct(_bare(F.get("own", i)).alias("a"), _bare(F.get("raw", i)).alias("b"))))
    one_to_one = (F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["a"])))) & (F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["b"]))))
    return met.where(one_to_one).select(*DOC, "item_id", F.lit(1.0).alias("coverage"), F.lit(1.0).alias("consistency")).distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, doc_hash, item_id, coverage, consistency for every leaked (document, item)."""
    bench = cut(_with_rare(benchmark_windows(benchmark), coverage), "benchmark")
    kinds = sorted((r["exact"], r["size"]) for r in bench.select("exact", "size").distinct().collect())  # 2 * (WINDOW - LITERAL + 1) values at most
    known = bench.select("hash").distinct()
    tokens = _tokens(keyed(docs), *DOC)
    if any(exact for exact, _ in kinds):
        both = keyed(docs).select(*DOC, template(F.col("text")).alias("tokens"), F.transform(words(F.col("text")), _plain).alias("plain"))
        tokens = both.select(*DOC, F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes"), "plain")
    of = {False: "hashes", True: "plain"}
    places = [F.transform(windows(F.col(of[exact]), n), lambda h, i: F.struct(i.alias("pos"), h.alias("hash"))) for exact, n in kinds or [(False, WINDOW)]]
    rows = tokens.select(*DOC, F.explode(reduce(lambda a, b: F.concat(a, b), places)).alias("place")).select(*DOC, "place.pos", "place.hash")
    met = cut(rows.join(known, "hash", "left_semi"), "met")
    candidates = cut(met.join(bench.where("rare").select("hash", "item_id"), "hash").select(*DOC, "item_id").distinct(), "candidates")
    expanded = candidates.join(bench, "item_id")
    same_window = _same_doc("e", "m") & (F.col("e.hash") == F.col("m.hash"))
    hits = expanded.alias("e").join(met.alias("m"), same_window).select("e.*", "m.pos", (F.col("m.pos") - F.col("e.ipos")).alias("offset"))
    hits = cut(hits, "hits")
    same = _same_doc("h", "c") & (F.col("h.item_id") == F.col("c.item_id")) & (F.col("h.offset") == F.col("c.offset"))
    share = F.when(F.col("n_windows") > 0, F.col("met") / F.greatest("n_windows", F.lit(1))).otherwise(0.0)
    found = (
        hits.alias("h")
        .join(_slot_check(docs, hits).alias("c"), same, "left")
        .select("h.*", F.coalesce("c.consistency", F.lit(1.0)).alias("consistency"))
        .where(F.col("consistency") >= CONSISTENT)
        .groupBy(*DOC, "item_id")
        .agg(
            F.size(F.collect_set(F.when(~F.col("exact"), F.col("ipos")))).alias("met"),
            F.size(F.collect_set("ipos")).alias("met_all"),
            F.first("n_windows").alias("n_windows"),
            F.first("n_all").alias("n_all"),
            F.min("consistency").alias("consistency"),
        )
        .select(*DOC, "item_id", F.when(share >= coverage, share).otherwise(F.col("met_all") / F.col("n_all")).alias("coverage"), "consistency")
        .where(F.col("coverage") >= coverage)
    )
    lines = _line_leaks(docs, benchmark).alias("l").join(found.alias("f"), _same_doc("l", "f") & (F.col("l.item_id") == F.col("f.item_id")), "left_anti")
    return found.unionByName(lines)


def without_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    found = cut(leaks(docs, benchmark, coverage).select(F.col("doc_id").alias("leak_id"), F.col("doc_hash").alias("leak_hash")).distinct(), "leaks")
    own_hash = F.xxhash64(docs["doc_id"], filled(docs["text"]))
    return docs.join(found, docs["doc_id"].eqNullSafe(found["leak_id"]) & (own_hash == found["leak_hash"]), "left_anti")
