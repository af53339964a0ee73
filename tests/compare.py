"""Runs queries and their SQL side by side; also a command: python tests/compare.py SF_DIR NAME..."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def views(d: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{d}/*.parquet"):
        q = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{q}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if hasattr(v, "as_integer_ratio") and not isinstance(v, (int, float)):
        return round(float(v), 6)
    return v


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def both(spark, d: str, query, sql: str) -> tuple[list, list]:
    df = query(spark, d)
    mine = rows(df.columns, df.collect())
    cur = views(d).execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    return mine, rows(names, cur.fetchall())


def main() -> None:
    import __spark_entry__ as e

    from taxaflow.runtime import session

    spark, (d, *names) = session(), sys.argv[1:]
    qs, sql = e.queries(), e.oracle_sql()
    for n in names or qs:
        t = time.time()
        try:
            if n in sql:
                a, b = both(spark, d, qs[n], sql[n])
                print(n, "ok" if a == b else f"DIFFERS: {len(set(a) - set(b))} only here, {len(set(b) - set(a))} only in SQL; {sorted(set(a) - set(b), key=repr)[:2]} {sorted(set(b) - set(a), key=repr)[:2]}", len(a), len(b), f"{time.time() - t:.1f} s", flush=True)
            else:
                print(n, "no SQL", qs[n](spark, d).count(), f"{time.time() - t:.1f} s", flush=True)
        except Exception as x:  # noqa: BLE001
            print(n, "FAILED", str(x)[:1500], flush=True)


if __name__ == "__main__":
    main()
