import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, toxic string, h1 string, times string, row string, key string"
SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu".split()


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


def table(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, len(r[1] or ""), "size", "toxic", "h1", "times", "row", "key") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return table(spark, rows())


def rows():
    rng = random.Random(5)
    shared, found = prose(rng, 70), []
    found += [(i, prose(rng, rng.randint(1, 120)), rng.choice(["xx", "yy", None]), f"s{i % 4}") for i in range(60)]
    found += [(100 + i, "same text for all of these documents here", "xx", "s0") for i in range(12)]
    found += [(200 + i, f"{prose(rng, 30)} {shared} {prose(rng, 20)}", "yy", "s1") for i in range(3)]
    found += [(300, None, None, None), (301, "", "xx", "s2"), (302, " \n\t ", "yy", None), (303, "1234 5678", "xx", "s3"), (None, "no id at all", "xx", "s1")]
    found += [(304, prose(rng, 30_000), "xx", "s2"), (305, "w" * 200_000, "yy", "s2"), (306, "é" * 10 + " ünï cödé \U0001f600", "yy", "s3")]
    found += [(307, "twice the same row", "xx", "s1")] * 2
    return found


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
