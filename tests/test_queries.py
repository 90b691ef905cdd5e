"""Every registered query of the base package against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from emberlog import audit, feeds  # noqa: F401  they register their queries
from emberlog import queries as base

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    con.execute("set memory_limit = '4GB'")
    con.execute("set max_temp_directory_size = '1GB'")  # a runaway statement fails instead of filling the disk
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(base.SQL))
def test_same_rows(spark, sql, name):
    df = base.QUERIES[name](spark, SF)
    result = sql.execute(base.SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted(repr(row) for row in result.fetchall())
    assert sorted(repr(tuple(r[c] for c in names)) for r in df.collect()) == expected


@pytest.mark.parametrize("name", sorted(base.QUERIES.keys() - base.SQL.keys()))
def test_rows(spark, name):
    assert base.QUERIES[name](spark, SF).count() > 0
