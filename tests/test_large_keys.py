"""Queries against their SQL where keys are larger than in the sample tables."""

import duckdb
import pytest

from changeloom.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture
def both(spark, tmp_path):
    """Makes a table by SQL over a sample table; then what a query gives and what its SQL gives, sorted."""

    def run(name, table, sql):
        con = duckdb.connect()
        con.execute(f"COPY ({sql.format(table=f"'{SF}/{table}.parquet'")}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        found = con.sql(ORACLE_SQL[name])
        mine = QUERIES[name](spark, str(tmp_path)).select(*found.columns).collect()
        return sorted(map(tuple, mine), key=repr), sorted(found.fetchall(), key=repr)

    return run


@pytest.mark.parametrize("name", ["a3_reassemble", "j13_inxact_detoast"])
@pytest.mark.parametrize("shift", [9_990, 10_000_000])
def test_values_of_large_ids(both, name, shift):
    """Documents' ids run past those at which tombstones' positions and taken-over values once began."""
    mine, want = both(name, "documents", f"SELECT * REPLACE (doc_id + {shift} AS doc_id) FROM {{table}} LIMIT 40")
    assert len(want) > 30
    assert mine == want


def test_years_past_9999(both):
    mine, want = both("n7_epoch_shift", "events", "SELECT * REPLACE (event_id * 6000 AS event_id) FROM {table}")
    assert any(len(day) > len("9999-12-31") for _, day, _ in want)
    assert mine == want
