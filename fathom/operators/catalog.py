"""Catalogue operators: dashboards, searches, recency, conversations, citations, health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import fuzzy, nested
from fathom.operators import names, tree


def due_between(deadlines: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Not submitted (null counts so) and due from ``as_of`` to ``days`` later, both included."""
    return deadlines.where((F.coalesce("is_submitted", F.lit(False)) == F.lit(False)) & F.col("due").between(as_of, as_of + F.expr(f"interval {days} days")))


def urgency(due: Column, as_of: Column) -> Column:
    hours = (F.unix_timestamp(due) - F.unix_timestamp(as_of)) / 3600
    return F.when(due.isNull(), "none").when(hours < 0, "overdue").when(hours < 24, "today").when(hours < 72, "soon").otherwise("later")


def day_label(due: Column, as_of: Column) -> Column:
    days = F.datediff(due, as_of)
    return F.when(days == 0, "today").when(days == 1, "tomorrow").otherwise(F.concat_ws("/", F.month(due).cast("string"), F.dayofmonth(due).cast("string")))


def in_folder(column: str, folder: int) -> Column:
    """Of one folder; 0 is the root, where null and 0 both lie."""
    return F.col(column).isNull() | (F.col(column) == 0) if folder == 0 else F.col(column) == folder


def recent(items: DataFrame, activity: DataFrame, n: int) -> DataFrame:
    """Items by last access, else last update; needs id, updated and (item_id, accessed_at)."""
    last = activity.groupBy(F.col("item_id").alias("id")).agg(F.max("accessed_at").alias("accessed"))
    return items.join(last, "id", "left").withColumn("recency", F.coalesce("accessed", "updated")).orderBy(F.desc_nulls_last("recency"), "id").limit(n)


def newest_items(activity: DataFrame, keep: int = 200) -> DataFrame:
    """One row an item, its latest, newest first; ``keep`` rows."""
    latest = activity.groupBy("item_type", "item_id").agg(F.max(F.struct("accessed_at", "seq")).alias("x"))
    return latest.select("item_type", "item_id", "x.accessed_at", "x.seq").orderBy(F.desc("accessed_at"), F.desc("seq")).limit(keep)


def matching(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def listed_conversations(conversations: DataFrame, messages: DataFrame, courses: DataFrame, text: str = "", course_id: int | None = None, n: int = 200) -> DataFrame:
    """The list of conversations (conv_id, title, course_id, pinned, updated): those with the text in title or messages, if one
    is given (stripped; % and _ stay wild), and of the course, if one is given, 0 being those of none. Adds course_name,
    n_messages and rank: pinned ones first, then by last change, then id; the first ``n``."""
    text, parts = text.strip(), []
    said = F.bool_or(F.col("content").ilike(f"%{text}%")) if text else F.lit(True)
    told = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"), said.alias("said"))
    if text:
        parts.append(F.coalesce("said", F.lit(False)) | F.coalesce(F.col("title").ilike(f"%{text}%"), F.lit(False)))
    if course_id is not None:
        parts.append(F.col("course_id").isNull() if course_id == 0 else F.col("course_id") == course_id)
    order = [F.desc_nulls_last("pinned"), F.desc_nulls_last("updated"), F.col("conv_id")]
    first = conversations.join(told, "conv_id", "left").where(matching(parts)).orderBy(*order).limit(n)
    ranked = first.withColumns({"n_messages": F.coalesce("n_messages", F.lit(0)), "rank": F.row_number().over(Window.orderBy(*order)).cast("long")})  # n rows
    return ranked.drop("said").join(courses.select("course_id", "course_name"), "course_id", "left")


def with_paths(found: DataFrame, files: DataFrame, folders: DataFrame) -> DataFrame:
    """Results (kind, id, ...) with path: a folder's own, a file's (id, folder_id) folder's; the root's label where there is none."""
    of_file = files.select(F.lit("file").alias("kind"), "id", F.col("folder_id").alias("at"))
    at = F.when(F.col("kind") == "folder", F.col("id")).otherwise(F.col("at"))
    placed = found.join(of_file, ["kind", "id"], "left").withColumn("at", at)
    ways = tree.paths(folders).select(F.col("id").alias("way_of"), "path")
    return placed.join(ways, F.col("at") == F.col("way_of"), "left").withColumn("path", F.coalesce("path", F.lit(tree.ROOT))).drop("at", "way_of")


def search_conversations(conversations: DataFrame, messages: DataFrame, text: str) -> DataFrame:
    """Conversations whose title or a message holds the text (case-insensitive; % and _ stay wild), with the number of
    their messages. One pre-aggregation of the messages serves both."""
    told = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"), F.bool_or(F.col("content").ilike(f"%{text}%")).alias("said"))
    joined = conversations.join(told, "conv_id", "left")
    return joined.where(F.col("title").ilike(f"%{text}%") | F.coalesce("said", F.lit(False))).withColumn("n_messages", F.coalesce("n_messages", F.lit(0))).drop("said")


def titles(messages: DataFrame) -> DataFrame:
    """conv_id, title: the first user message, blanks collapsed, 32 characters."""
    first = messages.where("role = 'user'").groupBy("conv_id").agg(F.min_by("content", "turn").alias("content"))
    return first.select("conv_id", F.substring(F.trim(F.regexp_replace("content", r"\s+", " ")), 1, 32).alias("title"))


def exported(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, markdown: title, then each message under its role, then the names it cites if there is a column ``cited``."""
    block = F.concat(F.lit("## "), F.when(F.col("role") == "user", "用户").when(F.col("role") == "assistant", "助手").otherwise(F.col("role")), F.lit("\n\n"), "content", F.lit("\n"))
    if "cited" in messages.columns:
        names = F.array_join("cited", "、", "未知资料")
        block = F.concat(block, F.when(F.size("cited") > 0, F.concat(F.lit("\n引用："), names, F.lit("\n"))).otherwise(""))
    body = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("block")))).alias("blocks"))
    text = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.coalesce(F.array_join(F.transform("blocks", lambda b: b["block"]), "\n"), F.lit("")))
    return conversations.join(body, "conv_id", "left").select("conv_id", text.alias("markdown"))


def neighbours(chunks: DataFrame, cited: DataFrame, key: list[str], reach: int = 1) -> DataFrame:
    """Chunks at most ``reach`` from each cited one of the same document."""
    wanted = cited.select(*key, F.col("chunk_index").alias("cited_index"), F.explode(F.sequence(F.col("chunk_index") - reach, F.col("chunk_index") + reach)).alias("chunk_index"))
    return chunks.join(wanted, [*key, "chunk_index"])


def related(wanted: DataFrame, files: DataFrame, group: str, n: int) -> DataFrame:
    """file_id, doc_id, rank: the newest ``n`` other files of the same group (null matches null) for each wanted file.

    Only the newest n + 1 of a group can be in a result, so the groups are cut to those before they are joined."""
    newest = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("doc_id")))
    top = files.select("doc_id", F.col(group).alias("of"), newest.alias("place")).where(F.col("place") <= n + 1)
    met = wanted.join(top, F.col(group).eqNullSafe(F.col("of")) & (F.col("doc_id") != F.col("file_id")))
    rank = F.row_number().over(Window.partitionBy("file_id").orderBy("place"))
    return met.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n).select("file_id", "doc_id", "rank")


def fuzzy_search(rows: DataFrame, query: str, cut: float = fuzzy.CUT, limit: int = 20) -> DataFrame:
    """Rows (kind, id, name) by score: folders before files, then by name; the first ``limit``. Scores below ``cut`` are
    not made."""
    return names.search_one(rows, query, limit, cut)


def state_summary(tasks: DataFrame) -> DataFrame:
    """Counts over all tasks; zeros for an empty table."""
    bad = F.col("status").isin("failed", "interrupted")
    return tasks.agg(
        F.count_if(F.col("status").isin("queued", "running", "cancelling")).alias("active"),
        F.count_if(bad).alias("failed"),
        F.count_if(bad & F.col("retryable")).alias("retryable"),
    )


def answered_count(records: Column) -> Column:
    """Of array<struct<answered boolean, status string, answered_at string>>: a boolean decides first, then a known
    status, then a time stamp; without any evidence null, not 0."""
    status = lambda r: F.lower(F.trim(r["status"]))
    value = lambda r: (
        F.when(r["answered"].isNotNull(), r["answered"].cast("int")).when(status(r).isin(*nested.YES), 1).when(status(r).isin(*nested.NO), 0).when(r["status"].isNull() & (F.coalesce(r["answered_at"], F.lit("")) != ""), 1)
    )
    evidence = F.filter(F.transform(records, value), lambda v: v.isNotNull())
    return F.when(F.size(evidence) > 0, F.aggregate(evidence, F.lit(0), lambda s, x: s + x))


# --- lifecycle -------------------------------------------------------------------------------------------------


def replaced(current: DataFrame, new: DataFrame, owner: str, owners: DataFrame | None = None) -> DataFrame:
    """All rows of the ``owners`` give way to the new ones; by default, of those in ``new``. An owner whose new list is
    empty must be named, and has no rows then."""
    owners = new.select(owner) if owners is None else owners.select(owner).union(new.select(owner))
    return current.join(owners.distinct(), owner, "left_anti").unionByName(new, allowMissingColumns=True)


def moved(rows: DataFrame, moves: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` of the rows whose ``key`` is in ``moves`` (key, to) takes the new value; the others stay."""
    return rows.join(moves, key, "left").withColumn(column, F.coalesce("to", column)).drop("to")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def upserted(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New values win where given; columns and rows that ``new`` lacks stay, and columns that only ``new`` has come in."""
    both = current.alias("c").join(new.alias("n"), key, "full_outer")
    columns = [F.coalesce(f"n.{c}", f"c.{c}").alias(c) if c in new.columns else F.col(f"c.{c}") for c in current.columns if c != key]
    return both.select(key, *columns, *(F.col(f"n.{c}") for c in new.columns if c not in current.columns))


def migrated(rows: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """Adds the columns that are missing (name -> type, default) and fills nulls with the default."""
    made = {n: (F.coalesce(F.col(n), F.lit(d)) if n in rows.columns else F.lit(d)).cast(t) for n, (t, d) in columns.items()}
    return rows.withColumns(made)


def reconciled(files: DataFrame, vectors: DataFrame) -> DataFrame:
    """code, level, file_id: ready files without vectors (error), vectors without a ready file (warning)."""
    ready = files.where("status = 'ready'").select(F.col("id").alias("file_id"))
    indexed = vectors.select("file_id").distinct()
    missing = ready.join(indexed, "file_id", "left_anti").select(F.lit("missing_vectors").alias("code"), F.lit("error").alias("level"), "file_id")
    orphaned = indexed.join(ready, "file_id", "left_anti").select(F.lit("orphan_vectors").alias("code"), F.lit("warning").alias("level"), "file_id")
    return missing.unionByName(orphaned)


def missing_files(files: DataFrame, listed: DataFrame) -> DataFrame:
    """code, level, file_id of files (id, path) whose source is not ``listed`` (path)."""
    gone = files.join(listed.select("path").distinct(), "path", "left_anti")
    return gone.select(F.lit("missing_files").alias("code"), F.lit("error").alias("level"), F.col("id").alias("file_id"))


def overview(files: DataFrame, listed: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: counts of files, bytes listed, counts of each issue, and whether there is no error."""
    issues = reconciled(files, vectors).unionByName(missing_files(files, listed))
    told = issues.agg(*(F.count_if(F.col("code") == c).alias(f"n_{c}") for c in ("missing_files", "missing_vectors", "orphan_vectors")), (F.count_if(F.col("level") == "error") == 0).alias("healthy"))
    counted = files.agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("status") == "ready").alias("n_ready"))
    return counted.crossJoin(listed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))).crossJoin(told)  # one row each


def health(issues: DataFrame, shown: int = 50) -> DataFrame:
    """code, level, n and the first ``shown`` items of each kind of issue; only those are gathered."""
    rank = F.row_number().over(Window.partitionBy("code", "level").orderBy("file_id"))
    first = issues.withColumn("rank", rank).where(F.col("rank") <= shown)
    items = first.groupBy("code", "level").agg(F.array_join(F.transform(F.array_sort(F.collect_list("file_id")), lambda x: x.cast("string")), ",").alias("items"))
    return issues.groupBy("code", "level").agg(F.count(F.lit(1)).alias("n")).join(items, ["code", "level"])
