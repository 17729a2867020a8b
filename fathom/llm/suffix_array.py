"""Repeated passages by a sparse suffix array.

Texts are sequences of hashed words (64 bits each, throughout). Of all suffixes, only those at content-selected
positions stay: starts of ``GRAM``-word grams whose hash is the least of ``SPAN`` neighbours, so two documents that
share ``PASSAGE`` words keep the same position inside them, with ``HEAD`` words or more of the passage to its right.
Suffixes whose first ``HEAD`` words no other document has are dropped by a pre-aggregated count.

Suffixes with the same ``LEFT`` words before and ``RIGHT`` words after their position are one class, so copies are
sorted once; a class that several documents have matches to the full extent of its context. One row a class is
range-partitioned and sorted by its words to the right. Within a run of equal heads each row meets its nearest rows
of other documents, in the order of the words to the right (the furthest reach to the right) and in that of the words
to the left, nearest first (the furthest reach to the left). Where no one row reaches furthest both ways, the match is
extended past the neighbours, with the running minimum of the common words, until neither reach can grow. Kept
positions lie so close that contexts of ``RIGHT`` and ``LEFT`` words chain into passages of any length.

Runs that a range border cuts (one or two a partition at most) are brought together for a second look of the same
kind. Those of more than ``RUN`` classes are never held in memory: all their ``PASSAGE``-word windows are hashed and
counted instead, which finds the same matches.

Defined cases: null, empty and short texts (under ``PASSAGE`` words) repeat nothing; repetition within one document
does not count, whereas rows with equal text but other ids are other documents; rows of equal id and text are one; null ids are
allowed; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.texts import filled, words
from fathom.session import cut

PASSAGE = 50
GRAM = 8
SPAN = 31
HEAD = 20  # PASSAGE - SPAN + 1
RIGHT = 52  # words of context: beyond the next kept position
LEFT = 31
RUN = 1 << 16  # classes of one head that are held in memory, at 0.5 KB each
_TAIL = RIGHT - HEAD
_KEY = 8 * (1 + _TAIL + LEFT)
_SLICE = 1 << 20  # words handled at a time
_ROWS = 1 << 13  # rows of whole runs handled at a time
DOC = ["doc_id", "doc_hash"]
CLASS = ["head", "around"]
_FACTOR = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_FACTOR, n, 1 << 64))


def _after(a: np.ndarray, n: int) -> np.ndarray:
    """a[i + n] for each i, 0 beyond the end."""
    return np.append(a[n:], np.zeros(min(n, len(a)), a.dtype))


def _polynomials(h: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of so many words from each position; the last ones run over the end."""
    power, made = {1: h}, []
    while 2 * max(power) <= max(sizes):
        n = max(power)
        power[2 * n] = power[n] * _power(n) + _after(power[n], n)
    for size in sizes:
        out, done = np.zeros(len(h), np.uint64), 0
        for n in sorted(power, reverse=True):
            if size - done >= n:
                out, done = out * _power(n) + _after(power[n], done), done + n
        made.append(out)
    return made


def _grams(h: np.ndarray) -> np.ndarray:
    gram = _polynomials(h, (GRAM,))[0]
    mixed = (gram ^ (gram >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(29))


def _heads(h: np.ndarray) -> np.ndarray:
    return _polynomials(h, (HEAD,))[0]


def _extreme(a: np.ndarray, best: np.ufunc, size: int, fill: int) -> np.ndarray:
    """best(a[i : i + size]) for each i, ``fill`` beyond the end."""
    shift = lambda x, n: np.append(x[n:], np.full(min(n, len(x)), fill, x.dtype))[: len(x)]
    n = 1
    while 2 * n <= size:
        a = best(a, shift(a, n))
        n *= 2
    return best(a, shift(a, size - n)) if n < size else a


def _thinned(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Inside a run of a repeated phrase every position ties, and all have the same words around them, so they match
    alike: one is enough for each ``LEFT`` words."""
    whole = at[(at >= LEFT) & (at + RIGHT <= len(h))]
    around = _polynomials(h, (LEFT + RIGHT,))[0][whole - LEFT]
    if len(np.unique(around)) == len(around):
        return at
    last: dict[int, int] = {}
    gone = []
    for i, c in zip(whole.tolist(), around.tolist(), strict=True):
        if i - last.get(c, -LEFT - 1) <= LEFT:
            gone.append(i)
        else:
            last[c] = i
    return np.setdiff1d(at, np.array(gone, at.dtype), assume_unique=True)


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept positions of one text's word hashes and the hashes of their heads."""
    if len(h) < PASSAGE:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    gram = _grams(h)[: len(h) - GRAM + 1]
    least = _extreme(gram, np.minimum, SPAN, 0)[: len(gram) - SPAN + 1]
    padded = np.concatenate((np.zeros(SPAN - 1, np.uint64), least, np.zeros(SPAN - 1, np.uint64)))
    chosen = _extreme(padded, np.maximum, SPAN, 0)[: len(gram)] == gram
    at = _thinned(h, np.flatnonzero(chosen[: len(h) - HEAD + 1]))
    return at, _heads(h)[at]


def _contexts(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of each position's context, which tells how much of it there is."""
    span = LEFT + RIGHT
    padded = np.concatenate((np.zeros(LEFT, np.uint64), h, np.zeros(RIGHT, np.uint64)))
    mixed = _polynomials(padded, (span,))[0][at] + np.minimum(at, LEFT).astype(np.uint64) * np.uint64(64) + np.minimum(len(h) - at, RIGHT).astype(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(29))


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(2)
        offsets = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        rows, places, heads, contexts, held = [], [], [], [], 0
        for i in range(len(b)):
            h = values[offsets[i] : offsets[i + 1]]
            at, head = anchors(h)
            if len(at):
                rows.append(np.full(len(at), i))
                places.append(at)
                heads.append(head)
                contexts.append(_contexts(h, at))
                held += len(at)
            if held and (held > _SLICE or i == len(b) - 1):
                take = pa.array(np.concatenate(rows))
                columns = [b.column(0).take(take), b.column(1).take(take), pa.array(np.concatenate(places).astype(np.int32))]
                columns += [pa.array(np.concatenate(x).view(np.int64)) for x in (heads, contexts)]
                yield pa.RecordBatch.from_arrays(columns, [*DOC, "pos", *CLASS])
                rows, places, heads, contexts, held = [], [], [], [], 0


def _suffix_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_hash, hashes, places (pos, around, shared) -> one row a class with its sort key: head, words to the right,
    words to the left (nearest first); 0 where the text ends."""
    reach = np.concatenate((np.arange(HEAD, RIGHT), -1 - np.arange(LEFT)))
    for b in batches:
        hash_at, place_at = (b.column(k).offsets.to_numpy() for k in (1, 2))
        hashes = b.column(1).values.to_numpy(zero_copy_only=False).view(np.uint64)
        pos, around, shared = b.column(2).values.flatten()
        positions = pos.to_numpy(zero_copy_only=False)
        for i in range(len(b)):
            h, first, last = hashes[hash_at[i] : hash_at[i + 1]], int(place_at[i]), int(place_at[i + 1])
            head = _heads(h)
            for k in range(first, last, _SLICE // 64):
                n = min(last - k, _SLICE // 64)
                at = positions[k : k + n]
                index = at[:, None] + reach
                inside = (index >= 0) & (index < len(h))
                context = np.where(inside, np.maximum(h[np.clip(index, 0, len(h) - 1)], np.uint64(1)), np.uint64(0))
                key = np.ascontiguousarray(np.concatenate((head[at][:, None], context), axis=1).astype(">u8"))
                column = pa.FixedSizeBinaryArray.from_buffers(pa.binary(_KEY), n, [None, pa.py_buffer(key)]).cast(pa.binary())
                own = b.column(0).take(pa.array(np.full(n, i)))
                yield pa.RecordBatch.from_arrays([column, own, shared.slice(k, n), around.slice(k, n)], ["key", "doc_hash", "shared", "around"])


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading equal words of each row pair; a blank (0) equals nothing."""
    unlike = (a != b) | (a == 0)
    return np.where(unlike.any(axis=1), unlike.argmax(axis=1), a.shape[1]).astype(np.int32)


def _partners(head: np.ndarray, doc: np.ndarray, shared: np.ndarray) -> list[np.ndarray]:
    """For each sorted row, the nearest rows of its run (equal heads) before and after it of another document; -1 where
    there is none. A class of several documents always has another one."""
    n = len(doc)
    new = np.append(True, (doc[1:] != doc[:-1]) | shared[1:] | shared[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0)) - 1
    stop = np.minimum.accumulate(np.where(np.append(new[1:], True), np.arange(n), n)[::-1])[::-1] + 1
    same = lambda partner: (partner >= 0) & (partner < n) & (head[np.clip(partner, 0, n - 1)] == head)
    return [np.where(same(start), start, -1), np.where(same(stop), stop, -1)]


def _furthest(order: np.ndarray, mine: np.ndarray, other: np.ndarray, head: np.ndarray, doc: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common words of each row with the nearest rows of other documents in this order, by ``mine`` (the side that is
    sorted) first and ``other`` second; the better of the two."""
    reach, along = np.full(len(doc), -1, np.int32), np.full(len(doc), -1, np.int32)
    for partner in _partners(head[order], doc[order], shared[order]):
        own = np.flatnonzero(partner >= 0)
        i, j = order[own], order[partner[own]]
        m, o = _common(mine[i], mine[j]), _common(other[i], other[j])
        better = (m > reach[i]) | ((m == reach[i]) & (o > along[i]))
        reach[i[better]], along[i[better]] = m[better], o[better]
    return reach, along


def extents(head: np.ndarray, right: np.ndarray, left: np.ndarray, doc: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words before and after the position that each row of whole runs (sorted by head and ``right``) has in common with
    rows of other documents in its run, in matches of ``PASSAGE`` words or more; 0, 0 without one."""
    n = len(doc)
    before, after = np.zeros(n, np.int32), np.zeros(n, np.int32)

    def note(i: np.ndarray, r: np.ndarray, x: np.ndarray) -> None:
        long = r + x >= PASSAGE
        np.maximum.at(before, i[long], x[long])
        np.maximum.at(after, i[long], r[long])

    rows = np.arange(n)
    full = np.flatnonzero(shared)
    note(full, HEAD + (right[full] != 0).sum(axis=1).astype(np.int32), (left[full] != 0).sum(axis=1).astype(np.int32))
    if n < 2:
        return before, after
    far_right, its_left = _furthest(rows, right, left, head, doc, shared)
    by_left = np.lexsort((*left.T[::-1], head))
    far_left, its_right = _furthest(by_left, left, right, head, doc, shared)
    own = np.flatnonzero(~shared & (far_right >= 0))
    note(own, HEAD + far_right[own], its_left[own])
    note(own, HEAD + its_right[own], far_left[own])
    # Running minima of these are the common words with rows further away; a run ends at -1.
    next_ = np.where(head[1:] == head[:-1], _common(right[:-1], right[1:]), -1)
    for step in (1, -1):
        i = own[(its_left[own] < far_left[own]) & (its_right[own] < far_right[own])]
        j, r, x = i.copy(), np.full(len(i), _TAIL, np.int32), np.full(len(i), -1, np.int32)
        while len(i):
            j = j + step
            inside = (j >= 0) & (j < n)
            i, j, r, x = i[inside], j[inside], r[inside], x[inside]
            r = np.minimum(r, next_[np.minimum(j, j - step)])
            going = (r > its_right[i]) & (x < far_left[i])
            i, j, r, x = i[going], j[going], r[going], x[going]
            met = (doc[i] != doc[j]) | shared[j]
            x[met] = np.maximum(x[met], _common(left[i[met]], left[j[met]]))
            note(i[met], HEAD + r[met], x[met])
    return before, after


_OUT = "head long, around long, before int, after int, part int"


def _run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of the key -> head, around, before, after. The first and the last run of a partition may go on in
    another one and long ones do not fit: these heads come back with the partition's number (or -1) for a second look."""
    names = [c.split()[0] for c in _OUT.split(", ")]
    part = TaskContext.get().partitionId()

    def arrays(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        column = b.column(0)
        at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(b)]
        raw = np.frombuffer(column.buffers()[2], np.uint8)
        key = raw[at[0] : at[0] + len(b) * _KEY].reshape(-1, _KEY).view(">u8").astype(np.uint64) if len(b) else np.empty((0, _KEY // 8), np.uint64)
        return key, b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy()

    def open_head(head: int, number: int) -> pa.RecordBatch:
        none = pa.nulls(1, pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([head], pa.int64()), pa.nulls(1, pa.int64()), none, none, pa.array([number], pa.int32())], names)

    def found(runs: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, doc, shared, around = (np.concatenate(x) for x in zip(*runs, strict=True))
        before, after = extents(key[:, 0], key[:, 1 : 1 + _TAIL], key[:, 1 + _TAIL :], doc, shared)
        at = np.flatnonzero(after)
        columns = [pa.array(key[at, 0].view(np.int64)), pa.array(around[at]), pa.array(before[at]), pa.array(after[at])]
        return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(at), pa.int32())], names)

    done, n_done, run, held, head, long, first = [], 0, [], 0, None, False, None
    for b in batches:
        whole = arrays(b)
        heads = whole[0][:, 0]
        borders = np.concatenate(([0], np.flatnonzero(heads[1:] != heads[:-1]) + 1, [len(heads)])) if len(heads) else []
        for a, z in zip(borders[:-1], borders[1:], strict=True):
            if heads[a] != head:
                done += run
                n_done += held
                run, held, head, long = [], 0, heads[a], False
                first = head if first is None else first
                if n_done > _ROWS:
                    yield found(done)
                    done, n_done = [], 0
            if not long:
                run.append(tuple(x[a:z] for x in whole))
                held += int(z - a)
                if held > RUN:
                    run, held, long = [], 0, True
                    yield open_head(int(head.astype(np.int64)), -1)
    if done or run:
        yield found(done + run)
    for edge in {int(x.astype(np.int64)) for x in (first, head) if x is not None}:
        yield open_head(edge, part)


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix rows -> window hash, doc_hash, shared, around, head, place of every PASSAGE-word window around the position that the
    context holds; place: its words to the left of the position."""
    reach = PASSAGE - HEAD
    for b in batches:
        column = b.column(0)
        at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(b)]
        if not len(b):
            continue
        key = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[0] + len(b) * _KEY].reshape(-1, _KEY).view(">u8").astype(np.uint64)
        head, to_right, to_left = key[:, 0], key[:, 1 : 1 + reach], key[:, 1 + _TAIL : 1 + _TAIL + reach]
        sums = []
        for side in (to_right, to_left):  # hashes of the nearest 0, 1, ... words; whole tells how many there are
            total = np.zeros((len(head), reach + 1), np.uint64)
            for k in range(reach):
                total[:, k + 1] = (total[:, k] + side[:, k] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
                total[:, k + 1] ^= total[:, k + 1] >> np.uint64(32)
            sums.append((total, np.where((side == 0).any(axis=1), (side == 0).argmax(axis=1), reach)))
        (right, n_right), (left, n_left) = sums
        hashes, rows, places = [], [], []
        for a in range(reach + 1):
            fits = np.flatnonzero((n_left >= a) & (n_right >= reach - a))
            mixed = (head[fits] ^ right[fits, reach - a]) * np.uint64(_FACTOR) + left[fits, a] * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(a)
            hashes.append((mixed ^ (mixed >> np.uint64(31))).view(np.int64))
            rows.append(fits)
            places.append(np.full(len(fits), a, np.int32))
        take = pa.array(np.concatenate(rows))
        columns = [pa.array(np.concatenate(hashes)), *(b.column(k).take(take) for k in (1, 2, 3)), pa.array(head.view(np.int64)).take(take), pa.array(np.concatenate(places))]
        yield pa.RecordBatch.from_arrays(columns, ["window", "doc_hash", "shared", "around", "head", "place"])


def _window_extents(rows: DataFrame) -> DataFrame:
    """head, around, before, after of these classes, by counting their windows."""
    windows = cut(rows.select("key", "doc_hash", "shared", "around").mapInArrow(_window_batches, "window long, doc_hash long, shared boolean, around long, head long, place int"), "windows")
    counted = windows.groupBy("head", "window").agg(F.min("doc_hash").alias("low"), F.max("doc_hash").alias("high"), F.bool_or("shared").alias("any")).where("low <> high or any")
    common = cut(counted.select("head", "window"), "common-windows")
    met = windows.join(common, ["head", "window"], "left_semi")
    return met.groupBy(*CLASS).agg(F.max("place").alias("before"), (PASSAGE - F.min("place")).alias("after"))


def class_extents(suffixes: DataFrame) -> DataFrame:
    """``suffixes`` (key, doc_hash, shared, around), a written table -> head, around, before, after of the classes that
    are part of a match."""
    parts = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "around"]
    found = cut(suffixes.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_run_batches, _OUT), "extents")
    met = found.where("part is null").select(*CLASS, "before", "after")
    # At most two heads a partition, besides long ones. Only those of several partitions were cut.
    open_ = found.where("part is not null").groupBy("head").agg(F.count_distinct("part").alias("n"), F.min("part").alias("low")).where("n > 1 or low < 0")
    open_ = cut(open_.select("head"), "open-heads")
    rows = suffixes.withColumn("head", F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long"))
    rows = cut(rows.join(open_, "head", "left_semi"), "open-runs")
    sizes = cut(rows.groupBy("head").agg(F.count(F.lit(1)).alias("n")), "open-sizes")
    whole = rows.join(sizes.where(F.col("n") <= RUN), "head", "left_semi").repartition(parts, "head").select("key", "doc_hash", "shared", "around")
    again = whole.sortWithinPartitions(*order).mapInArrow(_run_batches, _OUT).where("part is null").select(*CLASS, "before", "after")
    long = rows.join(sizes.where(F.col("n") > RUN), "head", "left_semi")
    return met.join(open_, "head", "left_anti").union(again).union(_window_extents(long))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, doc_hash, first, last: maximal runs of words (from, to before) that other documents share."""
    text = filled("text")
    hashes = F.transform(words(text), lambda w: F.xxhash64(w))
    tokens = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", text).alias("doc_hash"), hashes.alias("hashes"))
    placed = cut(tokens.mapInArrow(_anchor_batches, "doc_id long, doc_hash long, pos int, head long, around long"), "anchors")
    shared = placed.groupBy("head").agg(F.min("doc_hash").alias("low"), F.max("doc_hash").alias("high")).where("low <> high")
    shared = cut(shared.select("head"), "heads")  # apart from its counting, so that the join below can split a hot head
    members = cut(placed.join(shared, "head", "left_semi"), "members")
    first = F.min(F.struct("doc_hash", "doc_id", "pos")).alias("first")
    classes = members.groupBy(*CLASS).agg(first, (F.min("doc_hash") != F.max("doc_hash")).alias("shared"))
    places = classes.groupBy(F.col("first.doc_id").alias("at_id"), F.col("first.doc_hash").alias("at_hash")).agg(
        F.collect_list(F.struct("first.pos", "around", "shared")).alias("places")
    )
    places = cut(places, "places")
    raw = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", text).alias("doc_hash"), text.alias("text"))
    met = raw.join(places, raw["doc_id"].eqNullSafe(places["at_id"]) & (raw["doc_hash"] == places["at_hash"]))
    suffixes = met.select("doc_hash", hashes.alias("hashes"), "places").mapInArrow(_suffix_batches, "key binary, doc_hash long, shared boolean, around long")
    found = cut(class_extents(cut(suffixes, "suffixes")), "class-extents")
    matches = members.join(found, CLASS).select(*DOC, (F.col("pos") - F.col("before")).alias("first"), (F.col("pos") + F.col("after")).alias("last"))
    before = Window.partitionBy(*DOC).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    run = Window.partitionBy(*DOC).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, 0)
    return (
        matches.withColumn("opens", (F.coalesce(F.max("last").over(before), F.lit(-1)) < F.col("first")).cast("int"))
        .withColumn("island", F.sum("opens").over(run))
        .groupBy(*DOC, "island")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .drop("island")
    )
