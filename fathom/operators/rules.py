"""Small rules on rows: names, paths, references, queues, answers, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.text import strip
from fathom.session import cut

MOST_NAME = 100


def name_problem(name: Column) -> Column:
    """Why a folder name is refused, or null."""
    clean = strip(F.coalesce(name, F.lit("")))
    return F.coalesce(F.when(clean == "", "empty"), F.when(F.length(clean) > MOST_NAME, "too long"))


def inside(path: Column, root: str) -> Column:
    """Whether a normalised path lies below the root: no step up, no other start."""
    start = root.rstrip("/") + "/"
    return F.startswith(path, F.lit(start)) & ~path.rlike(r"(^|/)\.\.(/|$)")


def dangling(rows: DataFrame, column: str, targets: DataFrame, key: str) -> DataFrame:
    """Rows whose reference has no target; null refers to nothing."""
    return rows.where(F.col(column).isNotNull()).join(targets.select(F.col(key).alias(column)), column, "left_anti")


def saved_queue(items: DataFrame) -> DataFrame:
    """Finished items go, running ones wait again."""
    return items.where("status <> 'ready'").withColumn("status", F.when(F.col("status") == "processing", "queued").otherwise(F.col("status")))


def tagged_answer(text: Column, tag: str = "answer") -> Column:
    """What stands between <tag> and </tag>, without numbering or an option letter."""
    return F.regexp_replace(strip(F.regexp_extract(text, rf"(?is)<{tag}>(.*?)</{tag}>", 1)), r"^\s*(?:\(?[0-9]+[.)、]\s*|\(?[A-Za-z][.)、]\s*)", "")


def label(code: Column, names: dict[int, str], other: str = "unknown") -> Column:
    return F.coalesce(*(F.when(code == k, v) for k, v in names.items()), F.lit(other))


def ensured_folders(folders: DataFrame, paths: DataFrame) -> DataFrame:
    """path (folder names joined by /, lower case), depth, id of every folder that ``paths`` (parts array<string>)
    need; id is null where it has to be made. One left join by (parent, name) for each depth."""
    clean = F.filter(F.transform("parts", lambda p: F.lower(strip(p))), lambda p: p != "")
    wanted = cut(paths.select(clean.alias("parts")).distinct(), "paths")
    known = folders.select("id", "parent_id", F.lower("name").alias("folder_name"))
    deepest = wanted.agg(F.max(F.size("parts"))).first()[0] or 0  # one number
    out, level = None, None
    for depth in range(1, max(1, deepest) + 1):
        own = wanted.where(F.size("parts") >= depth)
        step = own.select(F.array_join(F.slice("parts", 1, depth - 1), "/").alias("above"), F.array_join(F.slice("parts", 1, depth), "/").alias("path"), F.get("parts", F.lit(depth - 1)).alias("folder_name")).distinct()
        if level is None:
            step = step.withColumn("of", F.lit(None).cast("long")).withColumn("exists_above", F.lit(True))
        else:
            step = step.join(level.select(F.col("path").alias("above"), F.col("id").alias("of")), "above").withColumn("exists_above", F.col("of").isNotNull())
        found = step.alias("s").join(known.alias("k"), F.col("s.of").eqNullSafe(F.col("k.parent_id")) & (F.col("s.folder_name") == F.col("k.folder_name")) & F.col("s.exists_above"), "left")
        level = cut(found.groupBy("s.path").agg(F.min("k.id").alias("id")).withColumn("depth", F.lit(depth).cast("long")), "level")
        out = level if out is None else out.unionByName(level)
    return out
