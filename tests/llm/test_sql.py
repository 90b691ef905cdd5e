"""The queries of the subpackage that have SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from emberlog.llm import queries as llm

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("set memory_limit = '4GB'")
    con.execute("set max_temp_directory_size = '1GB'")
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_same_rows(spark, sql, name):
    df = llm.queries()[name](spark, SF)
    result = sql.execute(llm.oracle_sql()[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted(repr(row) for row in result.fetchall())
    assert sorted(repr(tuple(r[c] for c in names)) for r in df.collect()) == expected
