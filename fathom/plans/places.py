"""Where things stand: labels of trees, paths in search results, places in the retrieved context, conversations by course."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import fuzzy
from fathom.operators import catalog as ct
from fathom.operators import intervals, scans
from fathom.operators import retrieval as rt
from fathom.plans import catalog, retrieval
from fathom.session import cut, table


def folder_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.labelled(catalog._folders(spark, sf_dir))


def folder_scope_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and nations as scopes: all folders at or below them."""
    folders = catalog._folders(spark, sf_dir)
    return intervals.scope(cut(intervals.labelled(folders), "labels"), folders.where("id < 1000"))


def source_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document lies below the one before it of its source: one chain a source, as deep as it has documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    after = scans.running(docs, "source", ["doc_id"], {"parent_id": scans.Carry("last_before", F.col("doc_id"))})
    return intervals.labelled(after.select(F.col("doc_id").alias("id"), "parent_id", F.col("source").alias("name")))


def search_with_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders and customers (files of their nation's folder; every fifth nation's lie in the root) by name, with paths."""
    folders = catalog._folders(spark, sf_dir)
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey") + 100).otherwise(0).cast("long").alias("folder_id"))
    named = folders.select(F.lit("folder").alias("kind"), "id", "name").unionByName(files.select(F.lit("file").alias("kind"), "id", "name"))
    scored = cut(named.withColumn("plain", fuzzy.normalized(F.col("name"))), "names").select("kind", "id", "name", F.round(fuzzy.dice_score(F.lit("nation1"), F.col("plain")), 6).alias("score"))
    found = scored.where(F.col("score") >= fuzzy.CUT).orderBy(F.desc("score"), F.col("kind") != "folder", "name", "id").limit(50)
    return ct.with_paths(found, files, folders)


def conversation_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations about a text in one course, and all those of no course, in the order of the list. The course is the number of
    user turns (none for one), the pinned ones have an odd number of turns, the last turn is the last change."""
    named, messages = catalog._titled(spark, sf_dir)
    told = messages.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("asked"), F.count(F.lit(1)).alias("turns"), F.max("turn").cast("long").alias("updated"))
    conversations = named.join(told, "conv_id").select("conv_id", "title", F.when(F.col("asked") > 1, F.col("asked")).alias("course_id"), (F.col("turns") % 2 == 1).alias("pinned"), "updated")
    courses = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("course_id"), F.col("n_name").alias("course_name"))
    lists = [ct.listed_conversations(conversations, messages, courses, text, course).withColumn("list", F.lit(name)) for name, text, course in (("course", " THE ", 2), ("none", "", 0), ("all", "a", None))]
    return lists[0].unionByName(lists[1]).unionByName(lists[2]).select("list", "rank", "conv_id", "course_name", "n_messages")


def retrieval_context_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are pages by their length (2,000 characters a page; short ones have no page), sections are their sources."""
    _, picked = retrieval._picked(spark, sf_dir)
    chosen = rt.final(picked, ["source", "lang"], min_relevance=0.2)
    kind = F.lit(None).cast("string")
    passages = chosen.withColumns(
        {"file": F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), "body": F.col("text"), "page": F.floor(F.length("text") / 2000), "location_type": kind, "location_index": F.lit(None).cast("long"), "section": F.col("source")}
    )
    made = rt.context(rt.located(passages), retrieval._queries(spark, sf_dir))
    return made.select("query_id", "insufficient", F.md5(F.col("context").cast("binary")).alias("context_md5"))


QUERIES = {f.__name__: f for f in (folder_intervals, folder_scope_ranges, source_chains, search_with_paths, conversation_filters, retrieval_context_places)}

_LIST = """(SELECT '{name}' AS list, row_number() OVER (ORDER BY pinned DESC, updated DESC, c.conv_id) AS rank, c.conv_id, n_name AS course_name, turns AS n_messages
    FROM c LEFT JOIN nation ON n_nationkey = course_id WHERE {keep} QUALIFY rank <= 200)"""

ORACLE_SQL = {
    "folder_intervals": f"""WITH RECURSIVE {catalog._FOLDERS}, t AS (
            SELECT id, id AS root_id, 0::BIGINT AS depth, [id] AS way FROM folders WHERE parent_id IS NULL
            UNION ALL SELECT f.id, t.root_id, t.depth + 1, list_append(t.way, f.id) FROM folders f JOIN t ON f.parent_id = t.id
        ), placed AS (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY way) - 1 AS place FROM t),
        sized AS (SELECT above AS id, count(*) AS n_below FROM (SELECT unnest(way) AS above FROM t) GROUP BY above)
        SELECT id, root_id, depth, 2 * place - depth AS first, 2 * place - depth + 2 * n_below - 1 AS last, n_below FROM placed JOIN sized USING (id)""",
    "folder_scope_ranges": f"""WITH RECURSIVE {catalog._FOLDERS}, t AS (
            SELECT id AS scope_id, id, 0::BIGINT AS depth FROM folders WHERE id < 1000
            UNION ALL SELECT t.scope_id, f.id, t.depth + 1 FROM folders f JOIN t ON f.parent_id = t.id
        ) SELECT * FROM t""",
    "source_chains": """WITH c AS (
            SELECT doc_id, min(doc_id) OVER s AS root_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS depth, count(*) OVER s AS n FROM documents WINDOW s AS (PARTITION BY source)
        ) SELECT doc_id AS id, root_id, depth, depth AS first, 2 * n - 1 - depth AS last, n - depth AS n_below FROM c""",
    "search_with_paths": "WITH RECURSIVE "
    + catalog._FOLDERS
    + """, ways AS (
            SELECT id, '根目录 / ' || name AS path FROM folders WHERE parent_id IS NULL
            UNION ALL SELECT f.id, ways.path || ' / ' || f.name FROM folders f JOIN ways ON f.parent_id = ways.id
        ), """
    + catalog._DICE.replace("WITH q", "q", 1).format(query="nation1", id="id", name="name", more="kind, name, folder_id,", rows="""(
            SELECT 'folder' AS kind, id, name, id AS folder_id FROM folders
            UNION ALL SELECT 'file', c_custkey, c_name, CASE WHEN c_nationkey % 5 <> 0 THEN c_nationkey + 100 ELSE 0 END FROM customer)""")
    + """SELECT kind, s.id, name, score, coalesce(path, '根目录') AS path FROM s LEFT JOIN ways ON ways.id = s.folder_id
        WHERE score >= 0.42 ORDER BY score DESC, kind <> 'folder', name, s.id LIMIT 50""",
    "conversation_filters": f"""WITH {catalog._MESSAGES}, told AS (
            SELECT conv_id, count(*) FILTER (role = 'user') AS asked, count(*) AS turns, max(turn) AS updated,
                bool_or(content ILIKE '%the%') AS the, bool_or(content ILIKE '%a%') AS a FROM m GROUP BY conv_id
        ), c AS (SELECT *, CASE WHEN asked > 1 THEN asked END AS course_id, turns % 2 = 1 AS pinned FROM told JOIN named USING (conv_id))
        SELECT * FROM {_LIST.format(name="course", keep="(the OR title ILIKE '%the%') AND course_id = 2")}
        UNION ALL SELECT * FROM {_LIST.format(name="none", keep="course_id IS NULL")}
        UNION ALL SELECT * FROM {_LIST.format(name="all", keep="a OR title ILIKE '%a%'")}""",
    "retrieval_context_places": retrieval._sql(
        retrieval._PICKS
        + """SELECT q.query_id, count(c.doc_id) = 0 AS insufficient,
            md5(coalesce(string_agg('【来源' || final_rank || '｜doc-' || doc_id || '｜' || CASE WHEN length(text) >= 2000 THEN '第 ' || (length(text) // 2000) || ' 页｜' || source
                ELSE '章节：' || source END || '】' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY final_rank), '')) AS context_md5
        FROM q LEFT JOIN chosen c ON c.query_id = q.query_id GROUP BY q.query_id"""
    ),
}
