"""Compare queries with their SQL on the same tables.

Run as ``python tests/oracle_check.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def local_session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("plumbline")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def oracle_rows(sf_dir: str, sql: str):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    cur = db.execute(sql)
    names = [d[0] for d in cur.description]
    types = [str(d[1]) for d in cur.description]
    return names, types, cur.fetchall()


def _key(row):
    return tuple((v is None, str(type(v)) if v is None else "", v if v is not None else 0) for v in row)


def _norm(v):
    if isinstance(v, float) and v == 0.0:
        return 0.0
    return v


def differences(names_a, rows_a, names_b, rows_b) -> list[str]:
    if sorted(names_a) != sorted(names_b):
        return [f"columns {sorted(names_a)} != {sorted(names_b)}"]
    order_a = sorted(range(len(names_a)), key=lambda i: names_a[i])
    order_b = sorted(range(len(names_b)), key=lambda i: names_b[i])
    a = sorted((tuple(_norm(r[i]) for i in order_a) for r in rows_a), key=_key)
    b = sorted((tuple(_norm(r[i]) for i in order_b) for r in rows_b), key=_key)
    out = []
    if len(a) != len(b):
        out.append(f"{len(a)} rows != {len(b)} rows")
    for x, y in zip(a, b):
        if x != y and not (all(_same(p, q) for p, q in zip(x, y))):
            out.append(f"{x} != {y}")
            if len(out) > 4:
                break
    return out


def _same(p, q) -> bool:
    if type(p) is not type(q):
        return False
    return p == q or (isinstance(p, float) and math.isnan(p) and math.isnan(q))


def check(spark, sf_dir: str, name: str):
    """Differences between query and SQL, and the seconds either took."""
    import __spark_entry__ as entry

    t0 = time.time()
    df = entry.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None, len(rows), t1 - t0, 0.0
    names, _, want = oracle_rows(sf_dir, sql)
    return differences(df.columns, rows, names, want), len(rows), t1 - t0, time.time() - t1


if __name__ == "__main__":
    import traceback

    import __spark_entry__ as entry

    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    session = local_session()
    bad = 0
    for query in args or entry.queries():
        try:
            found, n, a, b = check(session, folder, query)
        except Exception as e:
            traceback.print_exc(limit=3)
            found, n, a, b = [str(e).splitlines()[0][:600]], 0, 0, 0
        state = "rows only" if found is None else "ok" if not found else "DIFF"
        bad += bool(found)
        print(f"{query:28s} {state:10s} rows={n:<7d} spark={a:6.2f}s sql={b:5.2f}s", flush=True)
        for line in found or []:
            print("    ", line[:700], flush=True)
    print("bad:", bad)
