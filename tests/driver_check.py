"""Run registered queries beside their SQL in DuckDB and compare values.

    python tests/driver_check.py [sf] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

import __spark_entry__ as entry
from renderscope.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.10g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(norm(r[i]) for i in order) for r in rows], key=repr)


def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def compare(spark, con, folder, name):
    start = time.time()
    df = entry.queries()[name](spark, folder)
    got = df.collect()
    spent = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"SKIPPED: no SQL, rows={len(got)} {spent:.1f}s", None
    start = time.time()
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    duck_spent = time.time() - start
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(columns)}", False
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a == b:
        return f"ok rows={len(a)} {spent:.1f}s duck={duck_spent:.1f}s", True
    in_a, in_b = set(a), set(b)
    only_a = [r for r in a if r not in in_b][:3]
    only_b = [r for r in b if r not in in_a][:3]
    return f"DIFF {len(a)} vs {len(b)} cols={sorted(columns)}\n   spark {only_a}\n   duck  {only_b}", False


def main():
    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    bad = []
    for name in args[1:] or entry.queries():
        try:
            text, ok = compare(spark, con, folder, name)
        except Exception as e:  # report and go on
            text, ok = f"ERROR {type(e).__name__}: {str(e)[:400]}", False
        print(f"{name}: {text}", flush=True)
        bad += [name] if ok is False else []
    print("BAD:", bad)


if __name__ == "__main__":
    main()
