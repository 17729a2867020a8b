"""SimHash near-duplicates with pigeonring filtering.

Fingerprints of 64 bits are linked at ``LIMIT`` or fewer differing bits. Their bits form a ring of ``len(WIDTHS)``
segments. By the strong pigeonring principle a linked pair has a segment from which every chain of consecutive
segments keeps within its proportional budget: no difference in the first, at most one in the first two, two in the
first three, three in the first four. The first two segments are the bucket key (25 or 26 bits); as the second may
hold one difference, a fingerprint also visits the buckets next to its own. The longer chains prune what meets in a
bucket before the full check.

op9 links by that rule alone (``similar=None``). Without a contract, ``near_duplicates`` and ``keep_one`` also link all
texts whose sets of ``WORDS``-word shingles have a Jaccard similarity of ``SIMILAR`` or more, as 4 of 64 bits reach few of those under 0.95: MinHash bands name
the candidates (a pair at 0.8 is missed once in 20 million), the full shingle sets decide. Only buckets that hold
several components are looked at.

Equal fingerprints are one node, so copies cost nothing. A bucket returns a spanning forest of its links, not its
pairs; a large bucket is dealt out as pairs of blocks, each a bounded unit of work.

Defined cases: texts without a word have fingerprint zero and are linked like any other; a null id is the largest
id; repeated rows share a fingerprint; an empty table gives an empty result; extra columns are ignored by
``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.components import components
from fathom.llm.texts import ascii_lower, filled, words
from fathom.session import cut

SHINGLE = 4
SEED = 42
LIMIT = 4
WIDTHS = (13, 13, 13, 13, 12)
BUCKET = 2048  # distinct fingerprints in a block of a large bucket
WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 32, 4  # MinHash bands, and values in each
TEXTS = 1024  # texts of a large bucket of candidates that are held in memory at a time
CHUNK = 4096  # texts that pass by them in one unit
_TURNS = np.random.default_rng(SEED).integers(1 << 31, size=BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BLOCK = 1 << 16


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = min(size, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - last].tolist(), ends[last:].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - last)


def majority_bits(hashes: np.ndarray) -> int:
    """The fingerprint as a signed 64-bit integer; zero if there are no hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        block = np.ascontiguousarray(hashes[at : at + _BLOCK].astype("<u8")).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = [majority_bits(shingle_hashes(t.as_py())) for t in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints, pa.int64())], ["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp of every row."""
    text = filled("text")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(
        _fingerprint_batches, "doc_id long, text_hash long, fp long"
    )


def _masks(start: int) -> list[tuple[int, int]]:
    """(bits, most differences in them) of the chains of two segments or more from ``start``; the last is the whole."""
    chains, bits = [], 0
    for n in range(1, len(WIDTHS) + 1):
        i = (start + n - 1) % len(WIDTHS)
        bits |= ((1 << WIDTHS[i]) - 1) << sum(WIDTHS[:i])
        if n > 1:
            chains.append((bits, n * LIMIT // len(WIDTHS)))
    return chains


def _buckets(fp: Column) -> Column:
    """All places of a fingerprint: structs of start, key (the bits of two consecutive segments) and own. Its own
    keys have own = true. As the second segment may differ in one bit, the fingerprint also visits the keys with one
    of its set bits there cleared: of two fingerprints that differ in one bit, one has it set, so they meet."""
    places = []
    for start, width in enumerate(WIDTHS):
        after = (start + 1) % len(WIDTHS)
        first = F.shiftrightunsigned(fp, sum(WIDTHS[:start])).bitwiseAND(F.lit((1 << width) - 1))
        second = F.shiftrightunsigned(fp, sum(WIDTHS[:after])).bitwiseAND(F.lit((1 << WIDTHS[after]) - 1))
        key = (F.lit(start).cast("long") * (1 << 13) + first) * (1 << 13) + second
        places.append(F.array(F.struct(key.alias("bucket"), F.lit(True).alias("own"))))
        bits = F.filter(F.array(*(F.lit(1 << k).cast("long") for k in range(WIDTHS[after]))), lambda b: second.bitwiseAND(b) != 0)  # noqa: B023
        places.append(F.transform(bits, lambda b: F.struct((key - b).alias("bucket"), F.lit(False).alias("own"))))  # noqa: B023
    return F.concat(*places)


def _forest(start: int, prints: np.ndarray, own: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links in one unit, but for links between visitors, which meet elsewhere. Each
    node is expanded once against those not reached; ``own`` tells the bucket's own fingerprints from visitors."""
    chains = [(np.uint64(bits), most) for bits, most in _masks(start)]
    edges, left, mine = [], prints, own
    while mine.any():
        at = int(np.argmax(mine))
        queue, left, mine = [(left[at], True)], np.delete(left, at), np.delete(mine, at)
        while queue and len(left):
            node, home = queue.pop()
            other = (left ^ node).view(np.uint64)
            near = np.ones(len(other), bool) if home else mine.copy()
            for bits, most in chains:
                near &= np.bitwise_count(other & bits) <= most
            if near.any():
                found = left[near]
                edges += [(int(node), x) for x in found.tolist()]
                queue += list(zip(found, mine[near], strict=True))
                left, mine = left[~near], mine[~near]
    return edges


def _linked(start: int, a: int, b: int) -> bool:
    x = (a ^ b) & 0xFFFFFFFFFFFFFFFF
    return all((x & bits).bit_count() <= most for bits, most in _CHAINS[start])


_CHAINS = [_masks(s) for s in range(len(WIDTHS))]


def _forest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, block1, block2, fp, own) sorted by the first three; a unit that a batch cuts off waits for the next."""
    rows = np.empty((0, 5), np.int64)

    def edges_of(rows: np.ndarray) -> pa.RecordBatch:
        edges = []
        prints, own, kinds = rows[:, 3], rows[:, 4] > 0, rows[:, 0] >> 26
        at = np.flatnonzero(np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1), [True])))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            start = int(kinds[a])
            if b - a == 2:
                x, y = int(prints[a]), int(prints[a + 1])
                if x != y and own[a : b].any() and _linked(start, x, y):
                    edges.append((x, y))
            elif b - a > 2 and own[a:b].any():
                edges += _forest(start, prints[a:b], own[a:b])
        u, v = zip(*edges, strict=True) if edges else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for b in batches:
        rows = np.concatenate((rows, np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)))
        same = (rows[:, :3] == rows[-1:, :3]).all(axis=1)
        whole = len(rows) - int(same.sum())
        if whole:
            yield edges_of(rows[:whole])
            rows = rows[whole:]
    if len(rows):
        yield edges_of(rows)


def links(nodes: DataFrame, block: int = BUCKET) -> DataFrame:
    """``nodes`` (fp, distinct) -> (u, v): enough of the links to connect all that are linked."""
    keyed = nodes.select("fp", F.explode(_buckets(F.col("fp"))).alias("place")).select("fp", "place.bucket", "place.own")
    sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bool_or("own").alias("any")).where("n > 1 and any").drop("any")
    sizes = cut(sizes, "buckets")  # apart from its counting, so that the join can split a hot bucket
    blocks = F.ceil(F.col("n") / block).cast("int")
    units = (
        keyed.join(sizes, "bucket")
        .withColumn("blocks", blocks)
        .withColumn("in", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "bucket",
            F.least("in", "with").cast("long").alias("block1"),
            F.greatest("in", "with").cast("long").alias("block2"),
            "fp",
            F.col("own").cast("long").alias("own"),
        )
    )
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    unit = ["bucket", "block1", "block2"]
    return units.repartition(parts, *unit).sortWithinPartitions(*unit).mapInArrow(_forest_batches, "u long, v long")


def word_shingles(hashes: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Hashes of all runs of ``size`` words, distinct and sorted; fewer words are one run."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total = (total ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(32)
    return np.unique(total)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """Keys of the MinHash bands of a set of shingle hashes; texts without a word have none."""
    if not len(shingles):
        return np.empty(0, np.int64)
    least = np.full(len(_TURNS), 0xFFFFFFFF, np.uint32)
    folded = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
    for at in range(0, len(folded), 1024):
        np.minimum(least, (folded[at : at + 1024] * _TURNS).min(axis=0), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        keys = (keys ^ least[k::ROWS]) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).view(np.int64)))


def _per_text(make: Callable[[np.ndarray], np.ndarray]) -> Callable:
    """Rows (text_hash, hashes of the words) -> text_hash and the list that ``make`` gives for the hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(b), 256):
                found = [make(values[offsets[k] : offsets[k + 1]]) for k in range(i, min(i + 256, len(b)))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(found)), _lists(found)], ["text_hash", "found"])

    return run


def similar_to(own: np.ndarray, sets: list[np.ndarray], similar: float = SIMILAR) -> np.ndarray:
    """Places of the sets (sorted, distinct) with that Jaccard similarity to ``own``."""
    sizes = np.array([len(x) for x in sets])
    fits = np.flatnonzero((np.minimum(sizes, len(own)) >= similar * np.maximum(sizes, len(own)) - 1e-9) & (sizes > 0))
    if not len(fits) or not len(own):
        return np.empty(0, np.int64)
    others = np.concatenate([sets[i] for i in fits])
    at = np.minimum(np.searchsorted(own, others), len(own) - 1)
    common = np.add.reduceat((own[at] == others).astype(np.int64), np.concatenate(([0], np.cumsum(sizes[fits])[:-1])))
    return fits[common >= similar * (sizes[fits] + len(own) - common) - 1e-9]


def _meeting_batches(similar: float) -> Callable:
    """Rows (bucket, block, chunk, passing, component, found) sorted by the first four: in each unit a bounded number of
    sets is held, and the passing ones are compared with those of other components, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, of, top = None, [], np.empty(0, np.int64), {}

        def root(x: int) -> int:
            while top.get(x, x) != x:
                x = top[x]
            return x

        for b in batches:
            keys = list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
            passing, components_of, sets = b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5)
            offsets, values = sets.offsets.to_numpy(), sets.values.to_numpy(zero_copy_only=False).view(np.uint64)  # the order they are sorted in
            u, v = [], []
            for i, key in enumerate(keys):
                own, mine = values[offsets[i] : offsets[i + 1]], components_of[i]
                if key != unit:
                    unit, held, of, top = key, [], np.empty(0, np.int64), {}
                if not passing[i]:
                    held.append(own.copy())
                    of = np.append(of, mine)
                    continue
                open_ = np.flatnonzero(of != root(mine))
                for other in set(of[open_[similar_to(own, [held[k] for k in open_], similar)]].tolist()) if len(open_) else ():
                    u.append(mine)
                    v.append(other)
                    low, high = sorted((root(mine), root(other)))
                    top[high] = low
                    of[of == high] = low
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


_UNIT = ["bucket", "block", "chunk", "passing"]


def _met(held: DataFrame, passing: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """(u, v) of the components that meet: ``held`` and ``passing`` have bucket, block, chunk, component, text_hash."""
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = held.withColumn("passing", F.lit(0)).unionByName(passing.withColumn("passing", F.lit(1)))
    rows = cut(rows, "meetings").join(sets, "text_hash").select(*_UNIT, "component", "found")
    return rows.repartition(parts, *_UNIT[:3]).sortWithinPartitions(*_UNIT).mapInArrow(_meeting_batches(similar), "u long, v long")


def _active(members: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components."""
    several = members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    return cut(members.join(cut(several.select("bucket"), "active"), "bucket", "left_semi"), "members")


def _star_links(members: DataFrame, sets: DataFrame, similar: float, rank: Column) -> DataFrame:
    """Each text meets one text of each of its buckets, the first by ``rank``: work in proportion to the rows."""
    hubs = members.groupBy("bucket").agg(F.min(F.struct(rank.alias("rank"), "text_hash", "component")).alias("hub"))
    hubs = cut(hubs.select("bucket", F.col("hub.text_hash").alias("hub_hash"), F.col("hub.component").alias("hub_component")), "hubs")
    rays = cut(members.join(hubs, "bucket").where("component <> hub_component").select("hub_hash", "hub_component", "text_hash", "component").distinct(), "rays")
    counts = cut(rays.groupBy("hub_hash").agg(F.first("hub_component").alias("hub_component"), F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")), "hub-counts")
    unit = [F.col("hub_hash").alias("bucket"), F.lit(0).alias("block")]
    held = counts.select(*unit, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("hub_component").alias("component"), F.col("hub_hash").alias("text_hash"))
    passing = rays.join(counts.select("hub_hash", "chunks"), "hub_hash").select(*unit, F.pmod(F.xxhash64("text_hash"), F.col("chunks")).cast("int").alias("chunk"), "component", "text_hash")
    return _met(held, passing, sets, similar)


def _rest_links(members: DataFrame, sets: DataFrame, similar: float, block: int) -> DataFrame:
    """All that is left to compare: in each bucket, texts outside its largest component are held in blocks and meet all
    texts of the bucket that belong to other components."""
    counts = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.max("n").alias("most"), F.sum("n").alias("all"))
    blocks, chunks = F.ceil((F.col("all") - F.col("most")) / block), F.ceil(F.col("all") / CHUNK)
    sizes = cut(sizes.select("bucket", "largest", blocks.cast("int").alias("blocks"), chunks.cast("int").alias("chunks")), "bucket-sizes")
    sized = members.join(sizes, "bucket")
    dealt = lambda n: F.pmod(F.xxhash64("text_hash"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = sized.where("component <> largest").select("bucket", dealt("blocks").alias("block"), every("chunks").alias("chunk"), "component", "text_hash")
    passing = sized.select("bucket", every("blocks").alias("block"), dealt("chunks").alias("chunk"), "component", "text_hash")
    return _met(held, passing, sets, similar)


def _merged(members: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links as a written table, and the rows of buckets that hold several components even with them."""
    links = cut(links, "similar-links")
    roots = components(links)
    joined = members.join(roots, members["component"] == roots["u"], "left")
    return links, _active(joined.select("text_hash", "bucket", F.coalesce("root", "component").alias("component")))


def similar_links(docs: DataFrame, found: DataFrame, size: int = WORDS, similar: float = SIMILAR, block: int = TEXTS) -> DataFrame:
    """``found`` (text_hash, component) of all ``docs`` -> (u, v): links that connect all components with similar texts.

    Two rounds of stars join most of what is similar, at one comparison or so a text and bucket; what still belongs to
    several components in one bucket is compared in full."""
    text = filled("text")
    texts = docs.select(F.xxhash64(text).alias("text_hash"), F.transform(words(ascii_lower(text)), lambda w: F.xxhash64(w)).alias("hashes"))
    named = found.groupBy("text_hash").agg(F.min("component").alias("component"))
    banded = texts.mapInArrow(_per_text(lambda h: band_keys(word_shingles(h, size))), "text_hash long, found array<long>").groupBy("text_hash").agg(F.first("found").alias("bands"))
    members = _active(cut(banded.join(named, "text_hash").select("text_hash", "component", F.explode("bands").alias("bucket")), "bands"))
    wanted = cut(members.select("text_hash").distinct(), "wanted")
    sets = texts.join(wanted, "text_hash", "left_semi").mapInArrow(_per_text(lambda h: word_shingles(h, size).view(np.int64)), "text_hash long, found array<long>")
    sets = cut(sets.dropDuplicates(["text_hash"]), "shingles")
    found_links = []
    for rank in (F.lit(0), F.xxhash64("bucket", "text_hash")):  # the least hash of all, then another one in each bucket
        links, members = _merged(members, _star_links(members, sets, similar, rank))
        found_links.append(links)
    return found_links[0].union(found_links[1]).union(_rest_links(members, sets, similar, block))


def near_duplicates(docs: DataFrame, size: int = WORDS, similar: float | None = SIMILAR) -> DataFrame:
    """doc_id, text_hash, fp, component_id (least id that is reachable, itself included) of every row.

    Without ``similar``, fingerprints alone link."""
    prints = cut(fingerprints(docs), "fingerprints")
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    roots = components(links(nodes.select("fp")))
    rooted = nodes.join(roots, nodes["fp"] == roots["u"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    if similar is not None:
        rooted = cut(rooted, "rooted")
        met = components(similar_links(docs, prints.join(rooted, "fp").select("text_hash", F.col("root").alias("component")), size, similar))
        met = met.select(F.col("u").alias("root"), F.col("root").alias("top"))
        rooted = rooted.join(met, "root", "left").select("fp", "least_id", F.coalesce("top", "root").alias("root"))
    least = cut(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    named = rooted.join(least, "root").select("fp", "component_id", F.col("root").alias("component"))
    return prints.join(named, "fp")


def keep_one(docs: DataFrame, size: int = WORDS, similar: float | None = SIMILAR) -> DataFrame:
    """The document with the least id of each component, with all its columns; of rows with equal id and text, one."""
    found = near_duplicates(docs, size, similar)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    least = found.groupBy("component", order.alias("row")).agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct("row", "n")).alias("first")
    kept = least.groupBy("component").agg(first).select(F.xxhash64("first.row.doc_id", "first.row.text_hash").alias("kept_key"), F.col("first.row.text_hash").alias("kept_hash"), F.col("first.n").alias("n"))
    kept = cut(kept, "kept")
    text_hash = F.xxhash64(filled("text"))
    own = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("doc_id", text_hash).alias("kept_key"), text_hash.alias("kept_hash"))
    left = own.join(kept.select("kept_key", "kept_hash"), ["kept_key", "kept_hash"], "left_semi")
    if not kept.where("n > 1").isEmpty():  # without repeated rows, none need be dropped
        left = left.dropDuplicates(["kept_key", "kept_hash"])
    return left.select("row.*")
