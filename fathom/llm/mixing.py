"""Mixing sources to target weights as a min-cost flow.

Equal texts are one class; its membership pattern is the set of sources that hold it. Documents are summed by
pattern (words of distinct texts) and by pattern and source (words of all rows). Those sums form a small network:
start -> pattern, in levels of rising cost (first use of a text, second, third, any more: convex), pattern -> source,
up to ``MOST`` times the rows' words, source -> end, up to its target. Flow is pushed level by level, cheapest first;
as costs sit on the start arcs alone, that greedy order is optimal. The flow of a (pattern, source) pair then becomes
documents: whole passes over its rows, and a seeded share of one more pass, first copies before others, found by
prefix sums over hash buckets. The last document of a share is taken in part, so every source meets its target.

Only sums reach the driver: one row a source, and one for each pattern and source in it. All patterns are routed as
they are, whatever their number; beyond ``MOST_SUMS`` such rows the driver could not hold the network, and ``mix``
raises an error that states the number.

Defined cases: null text has size 0; a null source is a source, sorted last; null ids are allowed; documents of size
0 take 0; repeated rows are rows of their own; an empty table gives an empty result; extra columns are ignored by
``mix`` and kept by ``resample``.
"""

from __future__ import annotations

from collections import defaultdict, deque
from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.copies import BLOCK, numbered
from fathom.llm.texts import WORD, filled, twin_hash
from fathom.session import cut

WEIGHTS = (5.0, 2.0, 1.0)  # by source in order, repeating
MOST = 3  # times its own size that a document may be taken
MOST_SUMS = 1_000_000  # rows (pattern, source) of the network
BUCKET_ROWS = 20_000  # rows of the whole table for one hash bucket; the choice does not depend on their number
SEED = 20240229


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """Words by source: shares of the total by weight, at most ``most`` times the source, the excess shared again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    rest, open_, found = float(sum(sizes.values())), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if rest * weight[s] / total > most * sizes[s]]
        if not full:
            return found | {s: rest * weight[s] / total for s in open_}
        found |= {s: float(most * sizes[s]) for s in full}
        rest -= sum(found[s] for s in full)
        open_ = [s for s in open_ if s not in found]
    return found


def route(
    distinct: dict[int, int], words: dict[tuple[int, str], int], quota: dict[str, int], most: int = MOST, levels: int = 3
) -> dict[tuple[int, str], int]:
    """Flow by (pattern, source). ``distinct``: words of a pattern's distinct texts; ``words``: of its rows by source."""
    start, end = "start", "end"
    room: dict = defaultdict(dict)
    for (p, s), n in words.items():
        room[p, "p"][s, "s"] = most * n
        room[s, "s"].setdefault((p, "p"), 0)
    for s, n in quota.items():
        room[s, "s"][end] = n
        room[end][s, "s"] = 0

    def augment() -> bool:
        depth, queue = {start: 0}, deque([start])
        while queue:
            x = queue.popleft()
            for y, r in room[x].items():
                if r > 0 and y not in depth:
                    depth[y] = depth[x] + 1
                    queue.append(y)
        if end not in depth:
            return False
        arcs, at = {x: list(room[x]) for x in depth}, dict.fromkeys(depth, 0)
        path = [start]
        while path:
            x = path[-1]
            if x == end:
                steps = list(pairwise(path))
                push = min(room[a][b] for a, b in steps)
                for a, b in steps:
                    room[a][b] -= push
                    room[b][a] = room[b].get(a, 0) + push
                path = path[: 1 + next(i for i, (a, b) in enumerate(steps) if not room[a][b])]
                continue
            while at[x] < len(arcs[x]) and not (room[x][arcs[x][at[x]]] > 0 and depth.get(arcs[x][at[x]]) == depth[x] + 1):
                at[x] += 1
            if at[x] < len(arcs[x]):
                path.append(arcs[x][at[x]])
            else:
                path.pop()
                if path:
                    at[path[-1]] += 1
        return True

    for level in range(levels + 1):
        for p, n in distinct.items():
            more = n if level < levels else sum(quota.values())
            room[start][p, "p"] = room[start].get((p, "p"), 0) + more
            room[p, "p"].setdefault(start, 0)
        while augment():
            pass
    return {(p, s): room[s, "s"][p, "p"] for p, s in words}


def source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, key (of the source, never null), size, class hashes and n of the distinct records (n equal rows are
    one, so that no window holds them all); cut."""
    text = filled("text")
    h1, h2 = twin_hash(text)
    rows = docs.select("doc_id", "source", source_key("source").alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), h1.alias("h1"), h2.alias("h2"))
    return cut(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")), "sized")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, key (of the source), size, source_size, target, taken, pattern, h1, h2 of every row. Equal rows share what is
    left for them one after the other."""
    spark = docs.sparkSession
    rows = sized(docs)
    summed = rows.groupBy("source", "key").agg(F.sum(F.col("size") * F.col("n")).alias("n")).limit(MOST_SUMS + 1).collect()
    if len(summed) > MOST_SUMS:
        raise ValueError(f"more than {MOST_SUMS} sources; the flow is solved for that many pairs of membership pattern and source at most")
    sizes = {r.source: (r.key, r.n) for r in summed}
    wanted = targets({s: n for s, (_, n) in sizes.items()}, weights, most)

    copies = rows.groupBy("h1", "h2", "key").agg(F.min("doc_id").alias("first_id"), F.first("size").alias("class_size"), F.sum(F.col("size") * F.col("n")).alias("words"))
    classes = copies.groupBy("h1", "h2").agg(F.xxhash64(F.sort_array(F.collect_set("key"))).alias("pattern"))
    copies = cut(copies.join(classes, ["h1", "h2"]), "copies")
    one_source = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("key")) == 1
    sums = copies.withColumn("distinct", F.when(one_source, F.col("class_size")).otherwise(0)).groupBy("pattern", "key")
    sums = cut(sums.agg(F.sum("distinct").alias("d"), F.sum("words").alias("w")), "sums")
    if (n := sums.count()) > MOST_SUMS:
        raise ValueError(f"{n} pairs of membership pattern and source; the flow is solved for {MOST_SUMS} at most")
    sums = sums.collect()
    distinct: dict[int, int] = defaultdict(int)
    for r in sums:
        distinct[r.pattern] += r.d
    words = {(r.pattern, r.key): r.w for r in sums if r.w}
    quota = {key: round(wanted[s]) for s, (key, _) in sizes.items()}
    flow = route(dict(distinct), words, quota, most)

    plan = [(p, k, flow[p, k] // w, flow[p, k] % w) for (p, k), w in words.items()]
    plan = F.broadcast(spark.createDataFrame(plan, "pattern long, key string, passes long, share long"))
    facts = [(key, n, float(wanted[s])) for s, (key, n) in sizes.items()]
    facts = F.broadcast(spark.createDataFrame(facts, "key string, source_size long, target double"))

    # Rows stand in order of their draw, first copies ahead; buckets are its leading bits, so that order spans them.
    bits = max(4, ((rows.agg(F.sum("n")).first()[0] or 0) // BUCKET_ROWS).bit_length())
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "h1", "h2"), 1)
    placed = (
        rows.join(copies.select("h1", "h2", "key", "pattern", "first_id"), ["h1", "h2", "key"])
        .withColumn("drawn", drawn)
        .withColumn("bucket", F.when(F.col("doc_id").eqNullSafe(F.col("first_id")), 0).otherwise(1 << bits) + F.shiftright("drawn", 63 - bits))
        .select("doc_id", "key", "size", "h1", "h2", "n", "pattern", "drawn", "bucket")
    )
    placed = cut(placed, "placed")
    ahead = Window.partitionBy("pattern", "key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        placed.groupBy("pattern", "key", "bucket").agg(F.sum(F.col("size") * F.col("n")).alias("w")).select("pattern", "key", "bucket", F.coalesce(F.sum("w").over(ahead), F.lit(0)).alias("before"))
    )
    within = Window.partitionBy("pattern", "key", "bucket").orderBy("drawn", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("share") - F.col("before") - F.coalesce(F.sum(F.col("size") * F.col("n")).over(within), F.lit(0))
    extra = F.least(F.col("size"), F.greatest(F.lit(0), F.col("room") - F.col("copy") * F.col("size")))  # equal rows follow each other
    roomy = cut(placed.join(before, ["pattern", "key", "bucket"]).join(plan, ["pattern", "key"], "left").withColumn("room", room), "roomy")
    return (
        numbered(roomy, "n")
        .join(facts, "key")
        .select(
            "doc_id",
            "key",
            "size",
            "source_size",
            "target",
            (F.coalesce("passes", F.lit(0)) * F.col("size") + F.coalesce(extra, F.lit(0))).cast("long").alias("taken"),
            "pattern",
            "h1",
            "h2",
        )
    )


def resample(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mix itself: each document as many times as it is taken (a part counts as a whole), with all its columns."""
    times = F.ceil(F.col("taken") / F.greatest("size", F.lit(1)))
    row_key = F.xxhash64("doc_id", "key", "h1", "h2")
    taken = mix(docs, weights, most, seed).select(row_key.alias("taken_key"), F.col("h1").alias("taken_h1"), times.alias("times"))
    taken = taken.groupBy("taken_key", "taken_h1").agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("n")).where("times > 0")
    taken = cut(taken, "taken")
    h1, h2 = twin_hash(filled("text"))
    own = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("doc_id", source_key("source"), h1, h2).alias("taken_key"), h1.alias("taken_h1"))
    once = own.join(taken, ["taken_key", "taken_h1"])
    most_times, most_rows = taken.agg(F.coalesce(F.max("times"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if most_rows > 1:  # rows of equal id, source and text are counted together; without them, none need be dropped
        once = once.dropDuplicates(["taken_key", "taken_h1"])
    if most_times <= BLOCK:  # nothing to deal out by blocks
        return once.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")
    return numbered(once.select("row", F.col("times").cast("long").alias("times")), "times").select("row.*")
