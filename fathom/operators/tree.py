"""Folder trees as adjacency rows (id, parent_id, name). Ways up are found by pointer jumping: each round doubles how
far every folder has looked, so a tree of depth d takes log2(d) joins, and a way that meets itself is a cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.session import cut

ROOT = "根目录"


def ancestors(folders: DataFrame) -> DataFrame:
    """id, above (ids of all ancestors, nearest first), names (theirs), rooted (whether the way up ends at a folder
    without a parent; not so if a parent is missing or the way is a cycle). Of rows with equal ids, the least name counts."""
    own = folders.groupBy("id").agg(F.min(F.struct("name", "parent_id")).alias("x")).select("id", "x.name", "x.parent_id")
    own = cut(own, "folders")
    up = F.col("parent_id")
    parents = own.select(F.col("id").alias("of"), F.col("name").alias("parent_name"))
    rows = own.join(parents, up == F.col("of"), "left").select(
        "id",
        F.when(F.col("of").isNotNull(), up).alias("up"),
        F.when(up.isNull(), F.array().cast("array<bigint>")).otherwise(F.array(up.cast("long"))).alias("above"),
        F.when(F.col("of").isNull(), F.array().cast("array<string>")).otherwise(F.array("parent_name")).alias("names"),
        F.when(up.isNull(), True).when(F.col("of").isNull(), False).alias("rooted"),
    )
    while True:
        rows = cut(rows, "ways")
        if rows.where("up is not null").isEmpty():
            return rows.drop("up")
        further = rows.select(F.col("id").alias("at"), F.col("up").alias("next"), F.col("above").alias("more"), F.col("names").alias("more_names"), F.col("rooted").alias("ends"))
        way, names = F.concat("above", F.coalesce("more", F.array().cast("array<bigint>"))), F.concat("names", F.coalesce("more_names", F.array().cast("array<string>")))
        joined = rows.join(further, F.col("up") == F.col("at"), "left").select("id", "next", "rooted", "ends", way.alias("way"), names.alias("way_names"), F.col("up").isNull().alias("done"))
        cyclic = (F.size(F.array_distinct("way")) < F.size("way")) | F.array_contains("way", F.col("id"))
        rows = joined.withColumn("cyclic", ~F.col("done") & cyclic).select(
            "id",
            F.when(~F.col("cyclic"), F.col("next")).alias("up"),
            F.when(F.col("cyclic"), F.array_distinct("way")).otherwise(F.col("way")).alias("above"),
            F.col("way_names").alias("names"),
            F.when(F.col("done"), F.col("rooted")).when(F.col("cyclic"), False).otherwise(F.col("ends")).alias("rooted"),
        )


def descendants(folders: DataFrame, roots: DataFrame) -> DataFrame:
    """root_id, id, depth: every folder below each root (``roots``: id), the root itself at depth 0."""
    start = roots.select(F.col("id").alias("root_id"), "id", F.lit(0).cast("long").alias("depth"))
    below = ancestors(folders).select("id", F.posexplode("above").alias("pos", "root_id"))
    below = below.join(roots.select(F.col("id").alias("root_id")).distinct(), "root_id").select("root_id", "id", (F.col("pos") + 1).cast("long").alias("depth"))
    return start.unionByName(below).groupBy("root_id", "id").agg(F.min("depth").alias("depth"))


def effective_parents(folders: DataFrame) -> DataFrame:
    """id, parent_id, name, depth: a folder whose parent is missing, or that no root reaches (a cycle), is a root."""
    known = folders.select(F.col("id").alias("known")).distinct()
    linked = folders.join(known, folders["parent_id"] == known["known"], "left").select("id", F.when(F.col("known").isNotNull(), F.col("parent_id")).alias("parent_id"), "name")
    ways = ancestors(linked)
    return linked.join(ways, "id").select(
        "id", F.when(F.col("rooted"), F.col("parent_id")).alias("parent_id"), "name", F.when(F.col("rooted"), F.size("above")).otherwise(0).cast("long").alias("depth")
    )


def paths(folders: DataFrame) -> DataFrame:
    """id, path from the root label down; folders that no root reaches stand right below it."""
    above = F.when(F.col("rooted"), F.reverse("names")).otherwise(F.array().cast("array<string>"))
    return folders.join(ancestors(folders), "id").select("id", F.array_join(F.concat(F.array(F.lit(ROOT)), above, F.array("name")), " / ").alias("path"))


def in_root(parent: Column | str) -> Column:
    """Whether a folder reference means the root: null, or 0 as some clients write it."""
    parent = F.col(parent) if isinstance(parent, str) else parent
    return parent.isNull() | (parent == 0)


def orphans(folders: DataFrame) -> DataFrame:
    """Folders whose parent is gone."""
    parents = folders.select(F.col("id").alias("parent_id"))
    return folders.where("parent_id is not null").join(parents, "parent_id", "left_anti")


def without_folder(folders: DataFrame, files: DataFrame, folder_id: int) -> tuple[DataFrame, DataFrame]:
    """Folders and files after a folder was deleted: its children and files move to the root."""
    left = folders.where(F.col("id") != folder_id).withColumn("parent_id", F.when(F.col("parent_id") != folder_id, F.col("parent_id")))
    return left, files.withColumn("course_id", F.when(F.col("course_id") != folder_id, F.col("course_id")))
