"""Run registered queries in Spark and their check SQL in DuckDB; report differences.

    python tests/compare.py [name ...]
"""

from __future__ import annotations

import datetime as dt
import os
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from docketry.plans.catalog import QUERIES  # noqa: E402
from docketry.sources.sample_views import BASE_TABLES  # noqa: E402


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if value != value else float(f"{value:.9g}")
    if isinstance(value, int):
        return float(value)
    if isinstance(value, (dt.date, dt.datetime)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def difference(spark, con, name: str, folder: str) -> str | None:
    """None when both sides agree (or there is no check SQL)."""
    q = QUERIES[name]
    df = q.run(spark, folder)
    got = df.collect()
    if q.sql is None:
        return None
    cur = con.execute(q.check())
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    a, b = bag(df.columns, got), bag(cols, want)
    if a == b:
        return None
    order = sorted(cols)
    return (f"rows {len(got)} vs {len(want)}; columns {order}\n   spark only: {list((a - b).items())[:3]}"
            f"\n   check only: {list((b - a).items())[:3]}")


def main(names: list[str]) -> int:
    from docketry.session import local_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = local_session(8), connect(folder)
    bad = 0
    for name in names or list(QUERIES):
        start = time.time()
        try:
            problem = difference(spark, con, name, folder)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        rows = "" if QUERIES[name].sql else " (rows only)"
        print(f"{'FAIL' if problem else 'ok  '} {name}{rows} {time.time() - start:.1f}s" + (f"\n   {problem}" if problem else ""), flush=True)
        bad += problem is not None
    print(f"{bad} of {len(names or QUERIES)} differ")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
