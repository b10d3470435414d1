"""Run registered Spark queries next to their DuckDB oracle SQL and compare.

Usage: python tests/oracle_check.py [--sf DIR] [name ...]
Compares row count, column names and the order-insensitive multiset of rows.
"""

from __future__ import annotations

import argparse
import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from pactum.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 5)
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, name, fn, sql, sf_dir, con, verbose=True):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(_norm(x) for x in r) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return dict(name=name, ok=None, rows=len(s_rows), spark_s=t1 - t0)
    rel = con.execute(sql)
    d_cols = [d[0] for d in rel.description]
    d_rows = [tuple(_norm(x) for x in r) for r in rel.fetchall()]
    t2 = time.time()
    res = dict(name=name, rows=len(s_rows), oracle_rows=len(d_rows), spark_s=round(t1 - t0, 2),
               duck_s=round(t2 - t1, 2))
    if sorted(s_cols) != sorted(d_cols):
        res.update(ok=False, why=f"columns spark={s_cols} duck={d_cols}")
        return res
    order = [d_cols.index(c) for c in s_cols]
    d_rows = [tuple(r[i] for i in order) for r in d_rows]
    key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    s_sorted, d_sorted = sorted(s_rows, key=key), sorted(d_rows, key=key)
    if s_sorted == d_sorted:
        res.update(ok=True)
    else:
        diff_s = [r for r in s_sorted if r not in set(d_sorted)][:3]
        diff_d = [r for r in d_sorted if r not in set(s_sorted)][:3]
        res.update(ok=False, why=f"spark-only {diff_s} duck-only {diff_d}")
    return res


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    import __spark_entry__ as E
    from pactum.session import local_session
    spark = local_session()
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(a.sf)
    names = a.names or list(qs)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, qs[n], sqls.get(n), a.sf, con)
        except Exception as e:  # report and continue
            r = dict(name=n, ok=False, why=f"{type(e).__name__}: {str(e)[:400]}")
        if r.get("ok") is False:
            bad += 1
        print(r, flush=True)
    print(f"FAILED {bad} of {len(names)}")


if __name__ == "__main__":
    main()
