"""Runs registered queries on Spark and their SQL on DuckDB and compares the results.

usage: check_queries.py [sf_dir] [name pattern ...]
"""

import datetime
import decimal
import fnmatch
import importlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from skylattice.session import local_session  # noqa: E402


DIGITS = int(os.environ.get("CHECK_DIGITS", "9"))


def plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return 0.0 if v == 0 else float(f"{v:.{DIGITS}g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    patterns = sys.argv[2:] or ["*"]
    entry = importlib.import_module("__spark_entry__")
    queries, oracles = entry.queries(), entry.oracle_sql()
    spark = local_session(8)
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    bad = 0
    for name, run in queries.items():
        if not any(fnmatch.fnmatch(name, p) for p in patterns):
            continue
        start = time.time()
        try:
            df = run(spark, sf)
            mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
            took = time.time() - start
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"ERROR {name}: {str(error)[:700]}", flush=True)
            continue
        if name not in oracles:
            print(f"rows  {name}: {len(mine)} rows {took:.2f}s" + ("  EMPTY" if not mine else ""), flush=True)
            continue
        try:
            cursor = con.execute(oracles[name])
            names = [d[0] for d in cursor.description]
            theirs = rows_of(names, cursor.fetchall())
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"ORACLE {name}: {str(error)[:500]}", flush=True)
            continue
        if sorted(names) != sorted(df.columns):
            bad += 1
            print(f"NAMES {name}: {sorted(df.columns)} / {sorted(names)}", flush=True)
        elif mine != theirs:
            bad += 1
            diff = [(a, b) for a, b in zip(mine, theirs) if a != b][:2]
            print(f"DIFF  {name}: {len(mine)} / {len(theirs)} rows {sorted(names)} {diff}"[:900], flush=True)
        else:
            print(f"ok    {name}: {len(mine)} rows {took:.2f}s" + ("  EMPTY" if not mine else ""), flush=True)
    print(f"{bad} bad")


main()
