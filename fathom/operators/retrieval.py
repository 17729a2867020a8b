"""Hybrid retrieval: exact vector top-k, BM25 over candidates, coverage, fusion, diversity, threshold, context.

Every step takes and returns a DataFrame keyed by (query_id, doc_id); after the top-k, each query holds at most
``CANDIDATES`` rows, so the windows and groups over query_id are bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import text as tx
from fathom.functions import vectors
from fathom.operators import tree

# Sizes and weights of the ranking.
CANDIDATES, POOL, RESULTS = 10, 8, 3
MIN_RELEVANCE, DIVERSITY = 0.55, 0.72
HYBRID = {"vector": 0.68, "bm25": 0.22, "coverage": 0.10}
FINAL = {"rerank": 0.70, "vector": 0.18, "bm25": 0.08, "coverage": 0.04}
K1, B = 1.5, 0.75
QUERY_BLOCK = 2048


def scope_filter(course: Column, file: Column, courses: list | None = None, course_id: object = None, files: list | None = None) -> Column:
    """A list of courses wins over a single one; files restrict further; nothing given keeps all."""
    keep = F.lit(True)
    if courses:
        keep = course.isin(sorted(set(courses)))
    elif course_id is not None:
        keep = course == course_id
    return keep & file.isin(sorted(set(files))) if files else keep


def matrix_of(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def nearest_batches(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (block, part, passing, id, vector) sorted by the first three: in each unit the query vectors are held, the
    corpus passes by, and the best ``k`` a query (and ties) stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, names, wanted, held = None, [], [], []

        def found() -> pa.RecordBatch:
            sizes = [len(d) for d, _ in held]
            columns = [pa.array(np.repeat(np.concatenate(names), sizes)), pa.array(np.concatenate([d for d, _ in held])), pa.array(np.concatenate([x for _, x in held]))]
            return pa.RecordBatch.from_arrays(columns, ["query_id", "doc_id", "distance"])

        for b in batches:
            keys = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            edges = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)])) if len(keys) else []
            for start, stop in zip(edges[:-1], edges[1:], strict=True):
                if tuple(keys[start, :2]) != unit:
                    if held:
                        yield found()
                    unit, names, wanted, held = tuple(keys[start, :2]), [], [], []
                own, matrix = b.column(3).slice(start, stop - start).to_numpy(), matrix_of(b.column(4).slice(start, stop - start))
                if not keys[start, 2]:
                    names.append(own)
                    wanted.append(matrix)
                    held += [(np.empty(0, np.int64), np.empty(0))] * len(own)
                    continue
                if not held:
                    continue
                q = np.concatenate(wanted)
                gaps = (matrix * matrix).sum(axis=1)[None, :] + (q * q).sum(axis=1)[:, None] - 2 * q @ matrix.T
                for i, row in enumerate(gaps):
                    near = np.argpartition(row, k - 1)[:k] if len(row) > k else np.arange(len(row))
                    near = np.flatnonzero(row <= row[near].max() + 1e-9) if len(row) > k else near
                    d, x = np.concatenate((held[i][0], own[near])), np.concatenate((held[i][1], row[near]))
                    order = np.lexsort((d, x.round(9)))[:k]
                    held[i] = (d[order], x[order])
        if held:
            yield found()

    return run


def vector_topk(corpus: DataFrame, queries: DataFrame, k: int = CANDIDATES, block: int = QUERY_BLOCK) -> DataFrame:
    """``corpus`` (doc_id, embedding), ``queries`` (query_id, query_vector) -> query_id, doc_id, distance, vector_rank.

    Exact. Queries are dealt into blocks of about ``block`` and the corpus into parts; each (block, part) is a unit of
    work that keeps its best k a query, and a window over those ranks them. Only the number of queries reaches the
    driver."""
    parts = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = queries.where("query_vector is not null").select(F.col("query_id").cast("long").alias("id"), F.col("query_vector").cast("array<double>").alias("vector"))
    stored = corpus.where("embedding is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    blocks = max(1, -(-wanted.count() // block))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = wanted.select(dealt(blocks).alias("block"), every(parts).alias("part"), F.lit(0).alias("passing"), "id", "vector")
    passing = stored.select(every(blocks).alias("block"), dealt(parts).alias("part"), F.lit(1).alias("passing"), "id", "vector")
    units = held.union(passing).repartition(max(parts, min(blocks * parts, 16 * parts)), "block", "part").sortWithinPartitions("block", "part", "passing")
    partial = units.mapInArrow(nearest_batches(k), "query_id long, doc_id long, distance double")
    # Distances are compared as rounded, ties by id, so that every engine ranks alike.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 9), "doc_id"))
    return partial.withColumn("vector_rank", rank.cast("long")).where(F.col("vector_rank") <= k)


def with_bm25(candidates: DataFrame) -> DataFrame:
    """Adds bm25: over the candidates of each query only, divided by the best score. Needs query_tokens, tokens."""
    of_query = Window.partitionBy("query_id")
    sized = candidates.withColumns(
        {
            "n_docs": F.count(F.lit(1)).over(of_query),
            "mean_length": F.avg(F.size("tokens")).over(of_query),
            "length": F.greatest(F.size("tokens"), F.lit(1)),
        }
    )
    hits = (
        sized.select("query_id", "doc_id", "n_docs", "mean_length", "length", "tokens", F.explode(F.array_distinct("query_tokens")).alias("token"))
        .withColumn("tf", F.size(F.filter("tokens", lambda t: t == F.col("token"))))
        .where("tf > 0")
        .withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("query_id", "token")))
    )
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("length") / F.when(F.col("mean_length") == 0, 1.0).otherwise(F.col("mean_length")))
    raw = hits.groupBy("query_id", "doc_id").agg(F.sum(idf * F.col("tf") * (K1 + 1) / norm).alias("raw"))
    best = F.max("raw").over(of_query)
    return (
        candidates.join(raw, ["query_id", "doc_id"], "left")
        .withColumn("bm25", F.when(best > 0, F.coalesce("raw", F.lit(0.0)) / best).otherwise(0.0))
        .drop("raw")
    )


def with_hybrid(candidates: DataFrame) -> DataFrame:
    """Adds relevance, coverage, hybrid and hybrid_rank; needs distance, bm25, query_tokens, tokens, vector_rank."""
    scored = candidates.withColumns({"relevance": vectors.relevance(F.col("distance")), "coverage": tx.coverage(F.col("query_tokens"), F.col("tokens"))})
    hybrid = HYBRID["vector"] * F.col("relevance") + HYBRID["bm25"] * F.col("bm25") + HYBRID["coverage"] * F.col("coverage")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("hybrid", 9)), "vector_rank")
    return scored.withColumn("hybrid", hybrid).withColumn("hybrid_rank", F.row_number().over(order).cast("long"))


def _similarity(a: pd.Series, b: pd.Series) -> float:
    if a.embedding is None or b.embedding is None:
        left, right = set(a.tokens), set(b.tokens)
        return len(left & right) / len(left | right) if left | right else 0.0
    x, y = np.asarray(a.embedding, float), np.asarray(b.embedding, float)
    norm = float(np.sqrt(x @ x) * np.sqrt(y @ y)) if len(x) and len(y) else 0.0
    return max(0.0, min(1.0, float(x @ y) / norm)) if norm else 0.0


def mmr(candidates: DataFrame, pool: int = POOL, weight: float = DIVERSITY) -> DataFrame:
    """query_id, doc_id, mmr_rank, mmr_score of the greedy diverse picks; needs hybrid, hybrid_rank, embedding, tokens."""

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        left = list(rows.sort_values("hybrid_rank").itertuples(index=False))
        worst, chosen = [0.0] * len(left), []
        while left and len(chosen) < pool:
            scores = [weight * r.hybrid - (1 - weight) * w for r, w in zip(left, worst, strict=True)]
            best = max(range(len(left)), key=lambda i: (scores[i], -i))
            row = left.pop(best)
            worst.pop(best)
            chosen.append((row.query_id, row.doc_id, len(chosen) + 1, scores[best]))
            worst = [max(w, _similarity(row, r)) for w, r in zip(worst, left, strict=True)]
        return pd.DataFrame(chosen, columns=["query_id", "doc_id", "mmr_rank", "mmr_score"])

    needed = candidates.select("query_id", "doc_id", "hybrid", "hybrid_rank", "embedding", "tokens")
    return needed.groupBy("query_id").applyInPandas(pick, "query_id long, doc_id long, mmr_rank long, mmr_score double")


def final(candidates: DataFrame, place: list[str], min_relevance: float = MIN_RELEVANCE, n: int = RESULTS, rerank: Column | None = None) -> DataFrame:
    """Threshold, one row a place, best n a query. Without a reranker the final score is the hybrid one."""
    score = F.col("hybrid")
    if rerank is not None:
        outside = (rerank < 0) | (rerank > 1)
        squashed = F.when(outside, 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), rerank))))).otherwise(rerank)
        score = FINAL["rerank"] * squashed + FINAL["vector"] * F.col("relevance") + FINAL["bm25"] * F.col("bm25") + FINAL["coverage"] * F.col("coverage")
    ordered = candidates.withColumn("final", score).where(F.col("final") >= min_relevance)
    by_score = [F.desc(F.round("final", 9)), F.col("hybrid_rank")]
    first = ordered.withColumn("at_place", F.row_number().over(Window.partitionBy("query_id", *place).orderBy(*by_score))).where("at_place = 1").drop("at_place")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*by_score)).cast("long")
    return first.withColumn("final_rank", rank).where(F.col("final_rank") <= min(n, RESULTS))


def diagnostics(candidates: DataFrame, picked: DataFrame, selected: DataFrame) -> DataFrame:
    counted = candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_candidates"), F.round(F.max("hybrid"), 6).alias("best_score"))
    return (
        counted.join(picked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_pool")), "query_id", "left")
        .join(selected.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_selected")), "query_id", "left")
        .select("query_id", "n_candidates", F.coalesce("n_pool", F.lit(0)).alias("n_pool"), F.coalesce("n_selected", F.lit(0)).alias("n_selected"), "best_score")
    )


def best_windows(windows: DataFrame) -> DataFrame:
    """``windows`` (query_id, doc_id, score of one passage) -> query_id, doc_id, rerank: the best passage speaks for its text."""
    return windows.groupBy("query_id", "doc_id").agg(F.max("score").alias("rerank"))


def within_folders(candidates: DataFrame, folder: str, roots: DataFrame, folders: DataFrame) -> DataFrame:
    """Candidates whose folder is one of ``roots`` (id) or lies below one."""
    inside = tree.descendants(folders, roots).select(F.col("id").alias(folder)).distinct()
    return candidates.join(inside, folder, "left_semi")


def location_label(kind: Column, index: Column, section: Column) -> Column:
    """Where a passage stands. Indices below 1 and null count as none; a default section names no place."""
    numbered = lambda before, after="": F.when(index > 0, F.concat(F.lit(before), index.cast("string"), F.lit(after)))
    named = F.when(~F.coalesce(section, F.lit("")).isin("", tx.BODY), F.concat(F.lit("章节："), section))
    unit = F.when(kind == "page", numbered("第 ", " 页")).when(kind == "slide", numbered("第 ", " 张幻灯片"))
    return F.coalesce(unit, named, F.when(kind == "web_section", numbered("网页章节 ")), F.lit("位置未标注"))


def section_suffix(kind: Column, section: Column) -> Column:
    """A page or slide is followed by its section, unless that is the default one; else empty."""
    shown = kind.isin("page", "slide") & ~F.coalesce(section, F.lit("")).isin("", tx.BODY)
    return F.when(shown, F.concat(F.lit("｜"), section)).otherwise("")


def located(selected: DataFrame) -> DataFrame:
    """Adds place, as the label of a passage shows it, from page, location_type, location_index and section. Without a type, a
    page makes it one and all else stands under a heading; without an index above 0, the page counts."""
    page = F.when(F.col("page") > 0, F.col("page"))
    kind = F.coalesce(F.nullif("location_type", F.lit("")), F.when(page.isNotNull(), "page").otherwise("heading"))
    index = F.coalesce(F.when(F.col("location_index") > 0, F.col("location_index")), page)
    return selected.withColumn("place", F.concat(location_label(kind, index, F.col("section")), section_suffix(kind, F.col("section"))))


def context(selected: DataFrame, queries: DataFrame) -> DataFrame:
    """One text a query: labelled passages in order, or a note that there is no evidence. Needs file, place, body."""
    label = F.concat(F.lit("【来源"), F.col("final_rank").cast("string"), F.lit("｜"), "file", F.lit("｜"), "place", F.lit("】\n"), "body")
    joined = selected.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("final_rank", label.alias("part")))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n---\n\n")
    return queries.select("query_id").join(joined, "query_id", "left").select("query_id", F.coalesce(text, F.lit("")).alias("context"), F.col("parts").isNull().alias("insufficient"))
