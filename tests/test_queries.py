"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from changeloom.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    found = duck.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == names
    mine = sorted(tuple(map(plain, r)) for r in df.select(*names).collect())
    assert mine == sorted(tuple(map(plain, r)) for r in found.select(*[duckdb.ColumnExpression(n) for n in names]).fetchall())


def test_queries_without_sql():
    """DuckDB has no CRC-32C; ``test_raw.py`` holds that one to its definition."""
    assert set(QUERIES) - set(ORACLE_SQL) == {"n14_crc32c"}


def test_entry_and_plans(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "BatchEvalPython" not in plan
    pruned = QUERIES["f13_live_rows"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in pruned  # columns that nothing needs are not read
