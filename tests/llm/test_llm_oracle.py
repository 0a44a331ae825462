"""Queries that SQL can express, against DuckDB."""

import glob
import os

import duckdb
import pytest

from check_oracle import table
from tidepanel.llm import registry

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    df = registry.queries()[name](spark, SF_DIR)
    result = con.execute(registry.oracle_sql()[name])
    assert table(df.columns, df.collect()) == table([c[0] for c in result.description], result.fetchall())
