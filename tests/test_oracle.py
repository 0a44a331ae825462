"""Every registered query with SQL against DuckDB, the others for their rows."""

import functools
import glob
import os

import duckdb
import pytest

from check_oracle import table
from tidepanel.queries import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# On the smallest tables some series of these have too few points: three knots are
# no cubic, and a split without values leaves nothing to score.
DENSER = {name: "/root/testdata/sf0.01" for name in ("spline_cubic", "spline_cubic_blocked", "engineer_panel")}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@functools.cache
def connection(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    sf_dir = DENSER.get(name, SF_DIR)
    df = registry.queries()[name](spark, sf_dir)
    columns, rows = table(df.columns, df.collect())
    oracle = registry.oracle_sql().get(name)
    if oracle is None:
        assert rows
        return
    result = connection(sf_dir).execute(oracle)
    assert (columns, rows) == table([c[0] for c in result.description], result.fetchall())
