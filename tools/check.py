"""Run registered queries on Spark and their SQL on DuckDB, and compare the results value by value.

usage: python tools/check.py [sf_dir] [name ...]     (a name ending in * is a prefix)
"""
from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def normal(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [normal(x) for x in v]
    if isinstance(v, dict):
        return {k: normal(x) for k, x in v.items()}
    return v


def key(row):
    return tuple((x is None, str(type(x)), x if not isinstance(x, (list, dict)) else str(x)) for x in row)


def fetch_spark(df):
    cols = sorted(df.columns)
    rows = [tuple(normal(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    return cols, sorted(rows, key=lambda r: str(r)), {f.name: f.dataType.simpleString() for f in df.schema.fields}


def fetch_duck(con, sql):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(normal(r[i]) for i in order) for r in rel.fetchall()]
    types = {d[0]: str(d[1]) for d in rel.description}
    return [names[i] for i in order], sorted(rows, key=lambda r: str(r)), types


TYPE_MAP = {"double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "date": "DATE",
            "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def compare(spark, con, fn, sql, path):
    """None when equal, else what differs."""
    t0 = time.time()
    cols, rows, types = fetch_spark(fn(spark, path))
    took = time.time() - t0
    if sql is None:
        return None, len(rows), took
    dcols, drows, dtypes = fetch_duck(con, sql)
    if cols != dcols:
        return f"columns {cols} != {dcols}", len(rows), took
    bad_types = {c: (types[c], dtypes[c]) for c in cols if TYPE_MAP.get(types[c], dtypes[c]) != dtypes[c]}
    if len(rows) != len(drows):
        return f"rows {len(rows)} != {len(drows)}", len(rows), took
    diffs = [(a, b) for a, b in zip(rows, drows) if a != b]
    if diffs:
        return f"{len(diffs)} of {len(rows)} rows differ\n   cols {cols}\n   spark {diffs[0][0]}\n   duck  {diffs[0][1]}", len(rows), took
    if bad_types:
        return f"types differ {bad_types}", len(rows), took
    return None, len(rows), took


def connect(path):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet')")
    return con


def main():
    from marketframe.catalog import load
    from marketframe.session import local_session
    args = sys.argv[1:]
    path = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    queries, oracles = load()
    wanted = [q for q in queries if not args or any(q == a or (a.endswith("*") and q.startswith(a[:-1])) for a in args)]
    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    con = connect(path)
    bad = []
    for name in wanted:
        try:
            problem, n, took = compare(spark, con, queries[name], oracles.get(name), path)
        except Exception as e:  # noqa: BLE001
            problem, n, took = f"{type(e).__name__}: {str(e)[:700]}", -1, 0.0
        status = "FAIL" if problem else ("ok" if name in oracles else "rows")
        print(f"{status:5} {name:28} rows={n:7d} {took:6.2f}s{'  EMPTY' if n == 0 else ''}", flush=True)
        if problem:
            print("   ", problem, flush=True)
            bad.append(name)
    print(f"{len(wanted) - len(bad)} of {len(wanted)} fine; failing: {bad}")


if __name__ == "__main__":
    main()
