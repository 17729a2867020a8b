"""The fuzzy join against every pair."""

import random
import unicodedata
from difflib import SequenceMatcher
from os.path import splitext

import pytest
from pyspark.sql import functions as F

from fathom.operators import names


def normal(s):
    return "".join(c for c in unicodedata.normalize("NFKC", s or "").casefold() if c.isalnum())


def one(q, n, sequence):
    if not q or not n:
        return 0.0
    if q == n:
        return 1.0
    if q in n:
        return min(0.99, 0.9 + 0.09 * len(q) / len(n))
    if len(q) == 1:
        return 0.0
    pairs = lambda s: {s[i : i + 2] for i in range(max(len(s) - 1, 1))}
    dice = 2 * len(pairs(q) & pairs(n)) / (len(pairs(q)) + len(pairs(n)))
    return max(0.88 * SequenceMatcher(None, q, n).ratio() if sequence else 0.0, 0.92 * dice)


def every_pair(queries, held, sequence, cut=0.42):
    found = {}
    for q in {q for q in queries if q is not None}:
        for n in {n for n in held if n is not None}:
            best = max(one(normal(q), normal(n), sequence), one(normal(q), normal(splitext(n)[0]), sequence))
            if best >= cut:
                found[q, n] = round(best, 4)
    return found


def made(n, seed):
    rng = random.Random(seed)
    words = ["report", "final", "notes", "Water", "river", "课件", "数据库", "Straße", "ＡＢＣ", "x", "lab", "2024", "a1", "zz", "homework"]
    found = [rng.choice([" ", "_", "-", ""]).join(rng.choices(words, k=rng.randint(1, 4))) + rng.choice([".pdf", ".md", "", ".tar.gz"]) for _ in range(n)]
    scrambled = ["".join(rng.sample(w, len(w))) for w in found[: n // 3]]
    return [*found, *scrambled, None, "", "...", ".hidden", "..a.b", "a.b/c", "x..y", "x", "课", "aaaaaaaaaa", "ab" * 60, "ab" * 120]


@pytest.mark.parametrize("sequence", [True, False])
def test_join_against_every_pair(spark, sequence):
    held, queries = made(120, 1), made(40, 2)
    n, q = (spark.createDataFrame([(x,) for x in v * 2], f"{c} string") for v, c in ((held, "name"), (queries, "query")))
    got = {(r["query"], r["name"]): r.score for r in names.matches(n, q, sequence=sequence).collect()}
    want = every_pair(queries, held, sequence)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1.01e-4 for k in want)
    assert names.matches(n.limit(0), q).count() == 0 and names.matches(n, q.limit(0)).count() == 0


def test_plain_names_take_no_python(spark):
    n = spark.createDataFrame([("Report 1.pdf",), ("notes",)], "name string")
    plan = names.plain(n.where(F.octet_length("name") == F.length("name")), "name")._jdf.queryExecution().optimizedPlan().toString()
    branches = plan.split("Union")[-1]
    assert branches.count("ArrowEvalPython") <= 1 and "python_folded" in plan
    assert {r.plain for r in names.plain(n, "name").collect()} == {"report1pdf", "notes"}


def test_search_orders_and_limits(spark):
    rows = [("file", i, "big report") for i in range(50)] + [("folder", 90, "big report"), ("file", 91, "big reports"), ("file", 92, "other thing")]
    found = names.search(spark.createDataFrame(rows, "kind string, id long, name string"), spark.createDataFrame([("big report",), ("reports",)], "query string"), limit=3)
    got = {q: [(r.kind, r.id) for r in sorted(found.where(F.col("query") == q).collect(), key=lambda r: r["rank"])] for q in ("big report", "reports")}
    assert got["big report"] == [("folder", 90), ("file", 0), ("file", 1)]
    assert got["reports"][0] == ("file", 91)


def test_one_query_equals_the_join(spark):
    held = made(60, 5)
    n = spark.createDataFrame([("file", i, x) for i, x in enumerate(held)], "kind string, id long, name string")
    for query in ("final report.pdf", "课件", "x", "", None):
        got = {r.name: r.score for r in names.matches_one(n, query).collect()}
        want = {k[1]: v for k, v in every_pair([query], held, True).items()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1.01e-4 for k in want)
    assert [r.name for r in names.search_one(n, "report", 5).collect()] == [r.name for r in names.search(n, spark.createDataFrame([("report",)], "query string"), 5).orderBy("rank").collect()]
