"""Compare catalogue queries with their DuckDB twins: rows, column names and values.

Usage: python tools/check_oracles.py [--sf DIR] [query ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from oddsloom.plans.library import CATALOG  # noqa: E402
from oddsloom.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value + 0.0, 6) + 0.0)
    if value is None:
        return "~"
    return repr(value)


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    query = CATALOG[name]
    start = time.time()
    frame = query.build(spark, sf_dir)
    rows = [tuple(r) for r in frame.collect()]
    spent = time.time() - start
    if query.sql is None:
        return len(rows) > 0, f"rows-only {len(rows)} rows {spent:.1f}s"
    result = con.execute(query.sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(names) != sorted(frame.columns):
        return False, f"columns differ {sorted(set(names) ^ set(frame.columns))}"
    mine, theirs = table(rows, frame.columns), table(expected, names)
    if mine == theirs:
        return True, f"{len(rows)} rows {spent:.1f}s"
    mine_set, theirs_set = set(mine), set(theirs)
    only_mine = sorted(mine_set - theirs_set)[:2]
    only_theirs = sorted(theirs_set - mine_set)[:2]
    wrong = sum(1 for a, b in zip(mine, theirs) if a != b)
    return False, (
        f"MISMATCH rows {len(mine)} vs {len(theirs)}, {wrong} differ\n   {sorted(names)}\n"
        f"   spark {only_mine}\n   sql   {only_theirs}"
    )


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("queries", nargs="*")
    args = parser.parse_args()
    spark = local_session(8)
    con = connect(args.sf)
    failed = 0
    for name in args.queries or CATALOG:
        try:
            good, message = compare(spark, con, args.sf, name)
        except Exception as exc:  # noqa: BLE001 - report and go on with the next query
            good, message = False, f"ERROR {type(exc).__name__} {str(exc)[:700]}"
        failed += not good
        print(f"{'ok  ' if good else 'FAIL'} {name}: {message}", flush=True)
    print(f"{failed} failed of {len(args.queries or CATALOG)}")
    return failed


if __name__ == "__main__":
    sys.exit(main())
