"""Run registered queries and compare each with its SQL on DuckDB.

usage: check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

from tidepanel.queries import registry
from tidepanel.session import local_session


def norm(v):
    if isinstance(v, float) and v == 0:
        return 0.0
    return str(v) if type(v).__name__ in ("date", "datetime") else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(norm(r[i]) for i in order) for r in rows), key=lambda r: [str(x) for x in r]
    )


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(registry.queries())
    spark = local_session(8)
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    failed = []
    for name in names:
        start = time.time()
        try:
            df = registry.queries()[name](spark, sf_dir)
            cols, rows = table(df.columns, df.collect())
        except Exception as e:  # noqa: BLE001
            failed.append(name)
            print(f"FAIL {name}: {str(e)[:600]}", flush=True)
            continue
        took = time.time() - start
        oracle = registry.oracle_sql().get(name)
        if oracle is None:
            print(f"rows {name}: {len(rows)} rows {took:.2f}s {rows[:1]}", flush=True)
            continue
        try:
            res = con.execute(oracle)
            ocols, orows = table([c[0] for c in res.description], res.fetchall())
        except Exception as e:  # noqa: BLE001
            failed.append(name)
            print(f"FAIL {name} oracle: {str(e)[:600]}", flush=True)
            continue
        same = cols == ocols and rows == orows
        if same and rows:
            print(f"ok   {name}: {len(rows)} rows {took:.2f}s", flush=True)
        else:
            failed.append(name)
            diff = [(a, b) for a, b in zip(rows, orows) if a != b]
            print(f"DIFF {name}: {len(rows)} vs {len(orows)} rows, {cols} vs {ocols}, {len(diff)} differ: {diff[:3]}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
