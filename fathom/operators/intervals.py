"""Pre-order interval labels of folder trees: whether a folder lies below another is a range test on two numbers.

A tree is read as the walk around it: down into a folder, through its subfolders by id, and up again. Each step of the
walk knows the one before it, and pointer jumping (each round a step looks twice as far back) numbers all steps in
log2(steps) joins of one row a step. No row carries its ancestors, so a chain of any depth costs rows by its length only;
the largest group of subfolders is ordered by ranges (``scans``), not in one task.

Both sides of these joins grow with the table, so they are merged (``merge``): files of numbers in a row are far smaller
than the rows in them, and by the size of the files Spark would send all steps through the driver in each round.

Defined cases: of rows with equal ids, the least (name, parent) counts; a folder whose parent is missing is the root of a
tree of its own; folders on a cycle, or below one, are in no tree and have null labels; rows with a null id are left
out; an empty table stays empty; other columns are not read. Ids lie within plus and minus 2^61.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators import scans
from fathom.session import cut, discard

_DOWN = lambda c: F.shiftleft(F.col(c), 1)
_UP = lambda c: F.shiftleft(F.col(c), 1) + 1
_NONE = lambda: F.lit(None).cast("long")


def _walk(folders: DataFrame, most_rows: int) -> DataFrame:
    """step, before (null at the start of a tree), weight (+1 down, -1 up)."""
    own = folders.where("id is not null").groupBy("id").agg(F.min(F.struct("name", "parent_id")).alias("x")).select(F.col("id").cast("long").alias("id"), F.col("x.parent_id").cast("long").alias("parent_id"))
    own = cut(own, "folders")
    known = own.select(F.col("id").alias("known"))
    placed = own.where("parent_id is not null").join(known.hint("merge"), F.col("parent_id") == F.col("known"), "left").select("id", F.col("known").alias("parent"))
    linked = cut(placed.union(own.where("parent_id is null").select("id", "parent_id")), "linked")
    below = linked.where("parent is not null")
    after = scans.running(below, "parent", ["id"], {"sibling": scans.Carry("last_before", F.col("id"))}, most_rows)
    tops = linked.where("parent is null").select(_DOWN("id").alias("step"), _NONE().alias("before"))
    down = tops.union(after.select(_DOWN("id"), F.coalesce(_UP("sibling"), _DOWN("parent"))))
    children = linked.select("id", _NONE().alias("child")).union(below.select("parent", "id"))
    up = children.groupBy("id").agg(F.max("child").alias("child")).select(_UP("id").alias("step"), F.coalesce(_UP("child"), _DOWN("id")).alias("before"))
    return down.withColumn("weight", F.lit(1).cast("long")).union(up.withColumn("weight", F.lit(-1).cast("long")))


def labelled(folders: DataFrame, most_rows: int = scans.MOST_ROWS) -> DataFrame:
    """id, root_id, depth, first, last, n_below of folders (id, parent_id, name).

    ``first`` and ``last`` are the places of the steps down and up in the walk of the tree: a folder lies below another of
    the same root exactly if its ``first`` is between the other's. ``n_below`` counts the folder itself."""
    walk = cut(_walk(folders, most_rows), "walk")
    steps = walk.count()
    # Of the steps after ``before``, up to and with the own one: their number and the sum of their weights.
    rows = walk.select("step", "before", F.when(F.col("before").isNull(), F.col("step")).alias("start"), F.lit(1).cast("long").alias("since"), "weight")
    written = walk
    for _ in range(max(steps, 1).bit_length() + 1):  # further rounds would only go around cycles
        if rows.where("before is not null").isEmpty():
            break
        far = rows.select(F.col("step").alias("at"), F.col("before").alias("on"), F.col("start").alias("far_start"), F.col("since").alias("more"), F.col("weight").alias("more_weight"))
        open_rows = rows.where("before is not null").join(far.hint("merge"), F.col("before") == F.col("at"))
        moved = open_rows.select("step", F.col("on").alias("before"), F.col("far_start").alias("start"), (F.col("since") + F.col("more")).alias("since"), (F.col("weight") + F.col("more_weight")).alias("weight"))
        rows = cut(rows.where("before is null").select(*moved.columns).union(moved), "walk")
        discard(written)
        written = rows
    rows = rows.select(F.shiftright("step", 1).alias("id"), (F.col("step") % 2 == 0).alias("downward"), "before", "start", "since", "weight")
    ended, downward = F.col("before").isNull(), F.col("downward")
    told = rows.groupBy("id").agg(
        F.max(F.when(ended, F.shiftright("start", 1))).alias("root_id"),
        F.max(F.when(ended & downward, F.col("weight") - 1)).alias("depth"),
        F.max(F.when(ended & downward, F.col("since") - 1)).alias("first"),
        F.max(F.when(ended & ~downward, F.col("since") - 1)).alias("last"),
    )
    return told.withColumn("n_below", ((F.col("last") - F.col("first") + 1) / 2).cast("long"))


def scope(labels: DataFrame, roots: DataFrame) -> DataFrame:
    """scope_id, id, depth: the folders at or below each of ``roots`` (id), by labels alone; depth counts from there."""
    wanted = cut(labels.join(roots.select("id").distinct().hint("merge"), "id").select(F.col("id").alias("scope_id"), F.col("root_id").alias("of"), F.col("first").alias("low"), F.col("last").alias("high"), F.col("depth").alias("from_depth")), "scopes")  # of known size, so that the join sends these rows, not all labels
    inside = labels.join(wanted, (F.col("root_id") == F.col("of")) & F.col("first").between(F.col("low"), F.col("high")))
    return inside.select("scope_id", "id", (F.col("depth") - F.col("from_depth")).alias("depth"))
