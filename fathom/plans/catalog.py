"""Catalogue queries. Folders are regions, nations and suppliers; deadlines and reviews are orders; activity is events;
messages are conversations; files are documents and vectors are embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions import fuzzy
from fathom.functions import text as tx
from fathom.operators import catalog as ct
from fathom.operators import names as nm
from fathom.operators import segmentation as sg
from fathom.operators import rules, tree
from fathom.session import table

def _as_of() -> F.Column:
    return F.to_timestamp(F.lit("1998-01-01 00:00:00"))


def _folders(spark: SparkSession, sf_dir: str, without: F.Column | None = None) -> DataFrame:
    region = table(spark, sf_dir, "region").selectExpr("cast(r_regionkey + 1 as long) id", "cast(null as long) parent_id", "r_name name")
    nation = table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey + 100 as long) id", "cast(n_regionkey + 1 as long) parent_id", "n_name name")
    supplier = table(spark, sf_dir, "supplier").selectExpr("s_suppkey + 1000 id", "cast(s_nationkey + 100 as long) parent_id", "s_name name")
    every = region.union(nation).union(supplier)
    return every if without is None else every.where(~without)


def folder_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = _folders(spark, sf_dir)
    return tree.descendants(folders, folders.where("parent_id is null"))


def folder_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.paths(_folders(spark, sf_dir))


def folder_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With every fifth nation gone: its suppliers become roots."""
    return tree.effective_parents(_folders(spark, sf_dir, F.col("id").between(100, 999) & (F.col("id") % 5 == 0)))


def orphan_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.orphans(_folders(spark, sf_dir, F.col("id").between(100, 999) & (F.col("id") % 5 == 0))).select("id", "parent_id", "name")


def folder_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders, _ = tree.without_folder(_folders(spark, sf_dir), _folders(spark, sf_dir).withColumn("course_id", F.col("parent_id")), 101)
    return folders


def folder_ensure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that paths of region / nation / customer segment need: the last do not exist yet."""
    customer = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    parts = customer.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.array("r_name", F.lower("n_name"), "c_mktsegment").alias("parts"))
    return rules.ensured_folders(_folders(spark, sf_dir), parts)


def dangling_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return rules.dangling(orders, "o_custkey", table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0"), "c_custkey").select("o_orderkey", "o_custkey")


def union_search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders and files by name, folders first on equal scores."""
    folders = table(spark, sf_dir, "nation").selectExpr("'folder' kind", "cast(n_nationkey as long) id", "n_name name")
    files = table(spark, sf_dir, "supplier").selectExpr("'file' kind", "s_suppkey id", "s_name name")
    scored = folders.unionByName(files).withColumn("plain", fuzzy.normalized(F.col("name"))).withColumn("score", F.round(fuzzy.dice_score(F.lit("nation1"), F.col("plain")), 6)).drop("plain")
    return scored.where("score >= 0.42").orderBy(F.desc("score"), F.col("kind") != "folder", "name", "id").limit(50)


def fuzzy_name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").selectExpr("'file' kind", "p_partkey id", "p_name name")
    return ct.fuzzy_search(names, "smal widgit", limit=50).select("id", "name", "score")


def _name_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with their vowels exchanged, their second words alone, and supplier names (near none)."""
    parts = table(spark, sf_dir, "part").select("p_name").distinct()
    return (
        parts.select(F.translate("p_name", "aeio", "eioa").alias("query"))
        .union(parts.select(F.substring_index("p_name", " ", -1)))
        .union(table(spark, sf_dir, "supplier").select("s_name"))
        .distinct()
    )


def fuzzy_name_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names of parts against all queries, with the sequence score: distinct pairs from the cut on."""
    return nm.matches(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")), _name_queries(spark, sf_dir))


def fuzzy_dice_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without the sequence score, which SQL cannot say, and with the nations among the names."""
    held = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).union(table(spark, sf_dir, "nation").select("n_name"))
    return nm.matches(held, _name_queries(spark, sf_dir), sequence=False)


def fuzzy_dice_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), fuzzy.normalized(F.col("p_name")).alias("plain"))
    score = fuzzy.dice_score(F.lit("smalwidgit"), F.col("plain"))
    return names.select("id", F.round(score, 6).alias("score"))


def _deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_orderdate").alias("due"), (F.col("o_orderstatus") == "F").alias("is_submitted"))


def upcoming_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.due_between(_deadlines(spark, sf_dir), _as_of()).orderBy("due", "id").limit(20).select("id", "owner", "due")


def due_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = _deadlines(spark, sf_dir).where(~F.col("is_submitted") & (F.col("due") <= _as_of() + F.expr("interval 7 days")))
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), F.col("c_name").alias("course_name"))
    return reviews.orderBy("due", "id").limit(12).join(names, "owner", "left").select("id", "due", "course_name")


def deadline_urgency(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = _deadlines(spark, sf_dir).withColumn("urgency", ct.urgency(F.col("due"), _as_of()))
    return marked.groupBy("urgency", "is_submitted").agg(F.count(F.lit(1)).alias("n"))


def deadline_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deadlines(spark, sf_dir).groupBy(ct.day_label(F.col("due"), _as_of()).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def deadline_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth owner's deadlines replaced by those that are not submitted."""
    current = _deadlines(spark, sf_dir)
    new = current.where((F.col("owner") % 10 == 0) & ~F.col("is_submitted"))
    return ct.replaced(current, new, "owner").groupBy("owner").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_submitted").alias("submitted"))


def account_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third customer gets a new segment; other columns stay."""
    current = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = current.where("c_custkey % 3 = 0").select("c_custkey", F.lit("CHANGED").alias("c_mktsegment"))
    return ct.upserted(current, new, "c_custkey")


def schema_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
    return ct.migrated(rows, {"segment": ("string", "default"), "check_interval": ("long", 30)})


def _activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("item_type"), F.col("user_id").alias("item_id"), F.col("ts").alias("accessed_at"), F.col("event_id").alias("seq"))


def recency_top200(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.newest_items(_activity(spark, sf_dir), 200)


def recent_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.to_timestamp(F.lit("2024-01-15 00:00:00")).alias("updated"))
    return ct.recent(files, _activity(spark, sf_dir), 8).select("id", "source", "recency")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))


def _titled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    messages = _messages(spark, sf_dir)
    named = messages.select("conv_id").distinct().join(ct.titles(messages), "conv_id", "left")
    return named.select("conv_id", F.coalesce("title", F.lit("")).alias("title")), messages


def conversation_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.titles(_messages(spark, sf_dir))


def conversation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    named, messages = _titled(spark, sf_dir)
    return ct.search_conversations(named, messages, "THE a")


def conversation_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    named, messages = _titled(spark, sf_dir)
    return ct.exported(messages, named).select("conv_id", F.md5(F.col("markdown").cast("binary")).alias("markdown_md5"))


def conversation_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three turns of each conversation."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role"))
    return _messages(spark, sf_dir).withColumn("back", back.cast("long")).where("back <= 3").select("conv_id", "turn", "role", "back")


def regenerate_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each assistant message the user message before it."""
    before = Window.partitionBy("conv_id").orderBy("turn", "role").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(before)
    return _messages(spark, sf_dir).withColumn("asked_turn", asked).where("role = 'assistant'").select("conv_id", "turn", "asked_turn")


def citation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks around the middle one of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = sg.text_chunks(docs, ["doc_id"]).select("doc_id", "chunk_index", F.md5(F.col("text").cast("binary")).alias("text_md5"))
    cited = parts.groupBy("doc_id").agg((F.floor(F.max("chunk_index") / 2)).cast("long").alias("chunk_index"))
    return ct.neighbours(parts, cited, ["doc_id"])


def related_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every hundredth document the newest five others of the same source (null matches null)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return ct.related(docs.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "file_id"), docs, "source", 5)


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).distinct().withColumn("ok", F.lit(True))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).join(labelled, "id", "left").select("id", F.when(F.col("ok"), "ready").otherwise("uploaded").alias("status"))
    return ct.reconciled(files, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("file_id")))


def missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir).where("code = 'missing_vectors'").select("file_id", "level")


def orphan_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir).where("code = 'orphan_vectors'").select("file_id", "level")


def health_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.health(_issues(spark, sf_dir))


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first field that holds a value, of several names it may have."""
    props = table(spark, sf_dir, "events")
    found = F.coalesce(*(F.nullif(F.get_json_object("props", f"$.{k}"), F.lit("")) for k in ("key", "k", "id")))
    return props.select("event_id", found.try_cast("long").alias("k"))


QUERIES = {
    f.__name__: f
    for f in (
        folder_descendants, folder_paths, folder_tree, orphan_folders, folder_delete, folder_ensure, dangling_files, union_search_results, fuzzy_name_search, fuzzy_dice_search, fuzzy_name_join, fuzzy_dice_join,
        upcoming_deadlines, due_reviews, deadline_urgency, deadline_days, deadline_replace, account_upsert, schema_migration, recency_top200, recent_files,
        conversation_titles, conversation_search, conversation_export, conversation_tail, regenerate_source, citation_context, related_files,
        missing_vectors, orphan_vectors, health_report, json_fields,
    )
}

_FOLDERS = """
    folders AS (
        SELECT r_regionkey::BIGINT + 1 AS id, NULL::BIGINT AS parent_id, r_name AS name FROM region
        UNION ALL SELECT n_nationkey::BIGINT + 100, n_regionkey::BIGINT + 1, n_name FROM nation
        UNION ALL SELECT s_suppkey + 1000, s_nationkey::BIGINT + 100, s_name FROM supplier
    )
"""
_FEWER = _FOLDERS + ", fewer AS (SELECT * FROM folders WHERE NOT (id BETWEEN 100 AND 999 AND id % 5 = 0))"
_DICE = """
    WITH q AS (SELECT '{query}' AS q), n AS (SELECT {id} AS id, {more} lower(regexp_replace({name}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS n FROM {rows}),
    b AS (
        SELECT *, list_distinct(list_transform(generate_series(1, greatest(length(q) - 1, 1)), lambda i: substring(q, i, 2))) AS qb,
            list_distinct(list_transform(generate_series(1, greatest(length(n) - 1, 1)), lambda i: substring(n, i, 2))) AS nb FROM n, q
    ), s AS (
        SELECT *, round(CASE WHEN n = '' THEN 0.0 WHEN n = q THEN 1.0 WHEN contains(n, q) THEN least(0.99::DOUBLE, 0.9::DOUBLE + 0.09::DOUBLE * length(q) / length(n))
            ELSE 0.92::DOUBLE * 2 * len(list_intersect(qb, nb)) / (len(qb) + len(nb)) END, 6) AS score FROM b
    )
"""
_MESSAGES = """
    m AS (SELECT conv_id, turn, role, text AS content FROM conversations),
    first_user AS (SELECT conv_id, arg_min(content, turn) AS content FROM m WHERE role = 'user' GROUP BY conv_id),
    titles AS (SELECT conv_id, left(trim(regexp_replace(content, '\\s+', ' ', 'g'), ' '), 32) AS title FROM first_user),
    named AS (SELECT c.conv_id, coalesce(title, '') AS title FROM (SELECT DISTINCT conv_id FROM m) c LEFT JOIN titles t USING (conv_id))
"""
_ISSUES = """
    files AS (SELECT d.doc_id AS id, l.doc_id IS NOT NULL AS ready FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)),
    issues AS (
        SELECT 'missing_vectors' AS code, 'error' AS level, id AS file_id FROM files WHERE ready AND id NOT IN (SELECT vec_id FROM embeddings)
        UNION ALL SELECT 'orphan_vectors', 'warning', vec_id FROM embeddings WHERE vec_id NOT IN (SELECT id FROM files WHERE ready)
    )
"""
_DUE = "SELECT o_orderkey AS id, o_custkey AS owner, o_orderdate AS due, o_orderstatus = 'F' AS is_submitted FROM orders"

ORACLE_SQL = {
    "folder_descendants": f"""WITH RECURSIVE {_FOLDERS}, t AS (
            SELECT id AS root_id, id, 0::BIGINT AS depth FROM folders WHERE parent_id IS NULL
            UNION ALL SELECT t.root_id, f.id, t.depth + 1 FROM folders f JOIN t ON f.parent_id = t.id
        ) SELECT * FROM t""",
    "folder_paths": f"""WITH RECURSIVE {_FOLDERS}, t AS (
            SELECT id, '根目录 / ' || name AS path FROM folders WHERE parent_id IS NULL
            UNION ALL SELECT f.id, t.path || ' / ' || f.name FROM folders f JOIN t ON f.parent_id = t.id
        ) SELECT * FROM t""",
    "folder_tree": f"""WITH RECURSIVE {_FEWER}, linked AS (
            SELECT f.id, p.id AS parent_id, f.name FROM fewer f LEFT JOIN fewer p ON f.parent_id = p.id
        ), t AS (
            SELECT id, parent_id, name, 0::BIGINT AS depth FROM linked WHERE parent_id IS NULL
            UNION ALL SELECT l.id, l.parent_id, l.name, t.depth + 1 FROM linked l JOIN t ON l.parent_id = t.id
        ) SELECT * FROM t""",
    "orphan_folders": f"WITH {_FEWER} SELECT id, parent_id, name FROM fewer WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM fewer)",
    "folder_delete": f"WITH {_FOLDERS} SELECT id, CASE WHEN parent_id = 101 THEN NULL ELSE parent_id END AS parent_id, name FROM folders WHERE id <> 101",
    "folder_ensure": f"""WITH {_FOLDERS}, p AS (
            SELECT DISTINCT lower(r_name) AS a, lower(n_name) AS b, lower(c_mktsegment) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        ), one AS (SELECT a, min(f.id) AS id FROM (SELECT DISTINCT a FROM p) LEFT JOIN folders f ON f.parent_id IS NULL AND lower(f.name) = a GROUP BY a),
        two AS (SELECT a, b, min(f.id) AS id FROM (SELECT DISTINCT a, b FROM p) JOIN one USING (a) LEFT JOIN folders f ON f.parent_id = one.id AND lower(f.name) = b GROUP BY a, b),
        three AS (SELECT a, b, c, min(f.id) AS id FROM p JOIN two USING (a, b) LEFT JOIN folders f ON f.parent_id = two.id AND lower(f.name) = c GROUP BY a, b, c)
        SELECT a AS path, id, 1::BIGINT AS depth FROM one UNION ALL SELECT a || '/' || b, id, 2 FROM two UNION ALL SELECT a || '/' || b || '/' || c, id, 3 FROM three""",
    "dangling_files": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)",
    "union_search_results": _DICE.format(query="nation1", id="id", name="name", more="kind, name,", rows="""(
            SELECT 'folder' AS kind, n_nationkey::BIGINT AS id, n_name AS name FROM nation UNION ALL SELECT 'file', s_suppkey, s_name FROM supplier)""")
    + "SELECT kind, id, name, score FROM s WHERE score >= 0.42 ORDER BY score DESC, kind <> 'folder', name, id LIMIT 50",
    "fuzzy_dice_search": _DICE.format(query="smalwidgit", id="p_partkey", name="p_name", more="", rows="part") + "SELECT id, score FROM s",
    "fuzzy_dice_join": r"""
        WITH p AS (SELECT DISTINCT p_name FROM part), raw_q AS (
            SELECT translate(p_name, 'aeio', 'eioa') AS query FROM p UNION SELECT string_split(p_name, ' ')[-1] FROM p UNION SELECT s_name FROM supplier
        ), names AS (SELECT p_name AS name FROM p UNION SELECT n_name FROM nation
        ), q AS (SELECT query, lower(regexp_replace(query, '[^\p{L}\p{N}]+', '', 'g')) AS q FROM raw_q
        ), n AS (SELECT name, lower(regexp_replace(name, '[^\p{L}\p{N}]+', '', 'g')) AS n FROM names
        ), qb AS (SELECT *, list_distinct(list_transform(generate_series(1, greatest(length(q) - 1, 1)), lambda i: substring(q, i, 2))) AS qs FROM q
        ), nb AS (SELECT *, list_distinct(list_transform(generate_series(1, greatest(length(n) - 1, 1)), lambda i: substring(n, i, 2))) AS ns FROM n
        ), s AS (
            SELECT query, name, CASE WHEN n = '' OR q = '' THEN 0.0 WHEN n = q THEN 1.0 WHEN contains(n, q) THEN least(0.99::DOUBLE, 0.9::DOUBLE + 0.09::DOUBLE * length(q) / length(n))
                WHEN length(q) = 1 THEN 0.0 ELSE 0.92::DOUBLE * 2 * len(list_intersect(qs, ns)) / (len(qs) + len(ns)) END::DOUBLE AS score FROM qb, nb
        )
        SELECT query, name, round(score, 4) AS score FROM s WHERE score >= 0.42
    """,
    "upcoming_deadlines": f"""SELECT id, owner, due FROM ({_DUE}) WHERE NOT coalesce(is_submitted, false)
        AND due BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-01-08' ORDER BY due NULLS FIRST, id LIMIT 20""",
    "due_reviews": f"""WITH r AS (SELECT * FROM ({_DUE}) WHERE NOT is_submitted AND due <= TIMESTAMP '1998-01-08' ORDER BY due NULLS FIRST, id LIMIT 12)
        SELECT id, due, c_name AS course_name FROM r LEFT JOIN customer ON c_custkey = owner""",
    "deadline_urgency": f"""WITH h AS (SELECT is_submitted, (epoch(due) - epoch(TIMESTAMP '1998-01-01')) / 3600 AS h FROM ({_DUE}))
        SELECT CASE WHEN h IS NULL THEN 'none' WHEN h < 0 THEN 'overdue' WHEN h < 24 THEN 'today' WHEN h < 72 THEN 'soon' ELSE 'later' END AS urgency,
            is_submitted, count(*) AS n FROM h GROUP BY ALL""",
    "deadline_days": f"""SELECT CASE date_diff('day', DATE '1998-01-01', due::DATE) WHEN 0 THEN 'today' WHEN 1 THEN 'tomorrow'
            ELSE month(due) || '/' || day(due) END AS day, count(*) AS n FROM ({_DUE}) GROUP BY ALL""",
    "deadline_replace": f"""WITH d AS ({_DUE}), n AS (SELECT * FROM d WHERE owner % 10 = 0 AND NOT is_submitted),
        r AS (SELECT * FROM d WHERE owner NOT IN (SELECT owner FROM n) UNION ALL SELECT * FROM n)
        SELECT owner, count(*) AS n, count(*) FILTER (is_submitted) AS submitted FROM r GROUP BY owner""",
    "account_upsert": "SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "schema_migration": "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'default') AS segment, 30::BIGINT AS check_interval FROM customer",
    "recency_top200": """
        SELECT event_type AS item_type, user_id AS item_id, ts AS accessed_at, event_id AS seq FROM events
        QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1 ORDER BY accessed_at DESC, seq DESC LIMIT 200
    """,
    "recent_files": """
        SELECT doc_id AS id, source, coalesce(a, TIMESTAMP '2024-01-15') AS recency
        FROM documents LEFT JOIN (SELECT user_id, max(ts) AS a FROM events GROUP BY user_id) ON user_id = doc_id ORDER BY recency DESC, id LIMIT 8
    """,
    "conversation_titles": f"WITH {_MESSAGES} SELECT * FROM titles",
    "conversation_search": f"""WITH {_MESSAGES}
        SELECT n.conv_id, title, count(*) AS n_messages FROM named n JOIN m USING (conv_id) GROUP BY n.conv_id, title
        HAVING title ILIKE '%the a%' OR bool_or(content ILIKE '%the a%')""",
    "conversation_export": f"""WITH {_MESSAGES}
        SELECT n.conv_id, md5('# ' || title || chr(10) || chr(10) || string_agg('## ' || CASE role WHEN 'user' THEN '用户' WHEN 'assistant' THEN '助手' ELSE role END
            || chr(10) || chr(10) || content || chr(10), chr(10) ORDER BY turn,
            '## ' || CASE role WHEN 'user' THEN '用户' WHEN 'assistant' THEN '助手' ELSE role END || chr(10) || chr(10) || content || chr(10))) AS markdown_md5
        FROM named n JOIN m USING (conv_id) GROUP BY n.conv_id, title""",
    "conversation_tail": """
        SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS back FROM conversations QUALIFY back <= 3
    """,
    "regenerate_source": """
        WITH w AS (SELECT *, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (
            PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked_turn FROM conversations)
        SELECT conv_id, turn, asked_turn FROM w WHERE role = 'assistant'
    """,
    "citation_context": r"""
        WITH s AS (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 450)) AS s FROM documents),
        c AS (SELECT doc_id, s, regexp_replace(substring(text, s + 1, 500), '^\s+|\s+$', '', 'g') AS text FROM s),
        k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_index, text FROM c WHERE text <> ''),
        m AS (SELECT doc_id, max(chunk_index) // 2 AS cited_index FROM k GROUP BY doc_id)
        SELECT doc_id, chunk_index, cited_index, md5(text) AS text_md5 FROM k JOIN m USING (doc_id) WHERE abs(chunk_index - cited_index) <= 1
    """,
    "related_files": """
        SELECT f.doc_id AS file_id, d.doc_id, row_number() OVER (PARTITION BY f.doc_id ORDER BY d.doc_id DESC) AS rank
        FROM documents f JOIN documents d ON d.source IS NOT DISTINCT FROM f.source AND d.doc_id <> f.doc_id WHERE f.doc_id % 100 = 0 QUALIFY rank <= 5
    """,
    "missing_vectors": f"WITH {_ISSUES} SELECT file_id, level FROM issues WHERE code = 'missing_vectors'",
    "orphan_vectors": f"WITH {_ISSUES} SELECT file_id, level FROM issues WHERE code = 'orphan_vectors'",
    "health_report": f"""WITH {_ISSUES}, r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY file_id) AS k FROM issues)
        SELECT code, level, count(*) AS n, string_agg(CASE WHEN k <= 50 THEN file_id::VARCHAR END, ',' ORDER BY file_id) AS items FROM r GROUP BY code, level""",
    "json_fields": """SELECT event_id, TRY_CAST(coalesce(nullif(json_extract_string(props, '$.key'), ''), nullif(json_extract_string(props, '$.k'), ''),
        nullif(json_extract_string(props, '$.id'), '')) AS BIGINT) AS k FROM events""",
}
