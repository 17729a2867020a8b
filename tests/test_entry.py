"""Every registered query with SQL against DuckDB on the small tables; the others run."""

import math
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry
from fathom.plans import ALL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
OWN = {name: query for module in ALL for name, query in module.QUERIES.items()}
SQL = {name: sql for module in ALL for name, sql in module.ORACLE_SQL.items()}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(rows):
    fixed = lambda v: round(v, 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v
    return sorted((tuple(map(fixed, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    df = OWN[name](spark, SF)
    relation = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(relation.columns)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({SQL[name]})").fetchall()
    assert plain(map(tuple, df.select(columns).collect())) == plain(want)


@pytest.mark.parametrize("name", sorted(set(OWN) - set(SQL)))
def test_runs(spark, name):
    assert OWN[name](spark, SF).count() > 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
