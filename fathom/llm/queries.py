"""The registered queries of the training-data operators, with oracle SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import decontaminate, infilling, language, line_dedup, minhash, mixing, pages, quality, sharding, simhash, suffix_array, toxicity, whitening
from fathom.llm.sampling import is_held_out
from fathom.session import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "consistency")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_array.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("first").cast("long").alias("first_word"), F.col("last").cast("long").alias("end_word"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.edited(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        minhash.packed(F.col("code")).alias("fingerprint"),
        minhash.packed(F.col("edited_code")).alias("edited_fingerprint"),
        minhash.likeness(F.col("code"), F.col("edited_code")).alias("near_edited"),
        minhash.likeness(F.col("code"), F.col("next_code")).alias("near_next"),
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, docs.where(~is_held_out()))
    return found.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.deduplicate(table(spark, sf_dir, "documents"), min_docs=10)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, docs.where(~is_held_out()), table(spark, sf_dir, "labels"), cutoff=0.3)
    return found.select("doc_id", is_held_out().alias("held_out"), "score", "predicted")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), similar=None)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), n_shards=40)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation beyond a long is null."""
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), k=4)
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infilling.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    restored = infilling.restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored).alias("restored_sha256"))


def op13_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_decontamination": op2_decontamination,
    "op3_quality": op3_quality,
    "op4_suffix_array": op4_suffix_array,
    "op5_minhash": op5_minhash,
    "op6_language_id": op6_language_id,
    "op7_line_dedup": op7_line_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_simhash": op9_simhash,
    "op10_sharding": op10_sharding,
    "op11_whitening": op11_whitening,
    "op12_infilling": op12_infilling,
    "op13_pages": op13_pages,
}

_TEMPLATES = r"""
    parts AS (
        SELECT {id} AS id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS raw,
            regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]+') AS gaps FROM {rows}
    ), numbered AS (
        SELECT id, raw, list_transform(raw, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '#n' ELSE t END) AS ts,
            CASE WHEN regexp_matches(text, '^[\x20\x09-\x0D]') THEN gaps ELSE list_prepend('', gaps) END AS gaps FROM parts
    ), named AS (
        SELECT id, raw, gaps, list_transform(ts, lambda t, i: lower(CASE WHEN i > 1 AND gaps[i] IN (' ', chr(9)) AND regexp_matches(t, '^\p{{Lu}}')
            AND NOT regexp_matches(ts[i - 1], '[.!?:;|]$') THEN '#p' WHEN regexp_matches(t, '^[\p{{P}}\p{{S}}]*\p{{Lu}}') THEN '#o' ELSE t END)) AS ts FROM numbered
    ), bare AS (
        SELECT id, raw, gaps, list_transform(ts, lambda t: CASE WHEN regexp_matches(t, '[\p{{L}}#]') THEN regexp_replace(t, '[^\p{{L}}\p{{M}}\p{{N}}\p{{Z}}\p{{C}}#]+', '', 'g') ELSE t END) AS ts FROM named
    ), tokens AS (
        SELECT id, raw, list_transform(ts, lambda t, i: CASE WHEN i > 1 AND gaps[i] = ' ' AND ts[i - 1] = '#n' AND t IN ({units}) THEN '#u' ELSE t END) AS ts FROM bare
    )
"""
_UNITS = ", ".join(f"'{u}'" for u in decontaminate.UNITS.split())
_BARE = r"lower(regexp_replace({}, '^[\p{{P}}\p{{S}}]+|[\p{{P}}\p{{S}}]+$', '', 'g'))"

ORACLE_SQL = {
    # For items of at least a window's length, as all of the given ones are.
    "op2_decontamination": "WITH "
    + _TEMPLATES.format(id="doc_id", rows="documents", units=_UNITS).replace(" tokens AS", " doc_tokens AS")
    + r""", items AS (
            SELECT min(item_id) AS item_id, text FROM benchmark WHERE text IS NOT NULL GROUP BY text
        ), """
    + _TEMPLATES.format(id="item_id", rows="items", units=_UNITS).replace("parts", "iparts").replace("numbered", "inumbered").replace("named", "inamed").replace("bare AS", "ibare AS").replace("FROM bare", "FROM ibare").replace(" tokens AS", " item_tokens AS")
    + rf""", item_windows AS (
            SELECT id AS item_id, raw, ts, unnest(generate_series(0, len(ts) - 8)) AS ipos FROM item_tokens WHERE len(ts) >= 8
        ), bench AS (
            SELECT item_id, ipos, raw[ipos + 1 : ipos + 8] AS own, array_to_string(ts[ipos + 1 : ipos + 8], ' ') AS h,
                list_filter(generate_series(1, 8), lambda i: ts[ipos + i] IN ('#n', '#p', '#u', '#o')) AS slots
            FROM item_windows WHERE len(list_filter(ts[ipos + 1 : ipos + 8], lambda t: t IN ('#n', '#p', '#u'))) <= 3
        ), sizes AS (SELECT item_id, count(*) AS n_windows FROM bench GROUP BY item_id
        ), doc_windows AS (
            SELECT id AS doc_id, raw, list_transform(generate_series(0, len(ts) - 8), lambda k: array_to_string(ts[k + 1 : k + 8], ' ')) AS hs FROM doc_tokens WHERE len(ts) >= 8
        ), placed AS (SELECT doc_id, unnest(hs) AS h, generate_subscripts(hs, 1) - 1 AS pos FROM doc_windows
        ), hits AS (SELECT p.doc_id, p.pos, b.item_id, b.ipos, b.own, b.slots, p.pos - b.ipos AS "offset" FROM placed p JOIN bench b USING (h)
        ), pairs AS (
            SELECT h.doc_id, item_id, "offset", own, d.raw, pos, unnest(slots) AS i FROM hits h JOIN doc_windows d ON d.doc_id = h.doc_id
        ), values_ AS (
            SELECT doc_id, item_id, "offset", {_BARE.format('own[i]')} AS a, {_BARE.format('raw[pos + i]')} AS b FROM pairs
        ), sides AS (
            SELECT doc_id, item_id, "offset", 'item' AS side, a AS one, b AS other FROM values_
            UNION ALL SELECT doc_id, item_id, "offset", 'doc', b, a FROM values_
        ), agreed AS (SELECT doc_id, item_id, "offset", side, one, (min(other) = max(other))::INT AS same FROM sides GROUP BY ALL
        ), shares AS (SELECT doc_id, item_id, "offset", side, avg(same) AS same FROM agreed GROUP BY ALL
        ), checked AS (SELECT doc_id, item_id, "offset", min(same) AS consistency FROM shares GROUP BY ALL
        ), counted AS (
            SELECT h.doc_id, h.item_id, h.ipos, coalesce(c.consistency, 1.0) AS consistency FROM hits h
            LEFT JOIN checked c ON c.doc_id = h.doc_id AND c.item_id = h.item_id AND c."offset" = h."offset" WHERE coalesce(c.consistency, 1.0) >= 0.8
        )
        SELECT doc_id, item_id, count(DISTINCT ipos) / any_value(n_windows) AS coverage, min(consistency)::DOUBLE AS consistency
        FROM counted JOIN sizes USING (item_id) GROUP BY doc_id, item_id HAVING count(DISTINCT ipos) / any_value(n_windows) >= 0.3
    """,
    # Every run of 50 words that another document has, joined where they overlap or touch.
    "op4_suffix_array": r"""
        WITH w AS (
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
        ), windows AS (
            SELECT doc_id, list_transform(generate_series(0, len(ws) - 50), lambda k: md5(array_to_string(ws[k + 1 : k + 50], ' '))) AS hs
            FROM w WHERE len(ws) >= 50
        ), placed AS (
            SELECT doc_id, unnest(hs) AS h, generate_subscripts(hs, 1) - 1 AS k FROM windows
        ), shared AS (
            SELECT h FROM placed GROUP BY h HAVING count(DISTINCT doc_id) > 1
        ), hits AS (
            SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM placed SEMI JOIN shared USING (h)
        ), islands AS (
            SELECT doc_id, k, sum((before IS NULL OR k > before + 50)::INT) OVER (PARTITION BY doc_id ORDER BY k) AS island FROM hits
        )
        SELECT doc_id, min(k)::BIGINT AS first_word, (max(k) + 50)::BIGINT AS end_word FROM islands GROUP BY doc_id, island
    """,
    "op7_line_dedup": """
        WITH split_up AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
        ), lines AS (
            SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM split_up
        ), keyed AS (
            SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
        ), common AS (
            SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
        ), marked AS (
            SELECT k.*, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
}
