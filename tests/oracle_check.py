"""Run registered queries in Spark and their SQL oracles in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query: rows on both sides, column names and whether the
sorted rows are equal value for value.
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return repr(v)


def rows_key(rows):
    return sorted(tuple(norm(v) for v in r) for r in rows)


SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
               "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


def type_mismatches(sdf, res) -> list:
    """Columns whose Spark type and DuckDB type differ (by family name)."""
    duck_types = {d[0]: str(d[1]).upper() for d in res.description}
    out = []
    for f in sdf.schema.fields:
        want = SPARK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString().upper())
        got = duck_types.get(f.name)
        if got is not None and got != want:
            out.append((f.name, f.dataType.simpleString(), got))
    return out


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    types = type_mismatches(sdf, res)
    d_rows = res.fetchall()
    t2 = time.time()
    order = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
    dorder = sorted(range(len(d_cols)), key=lambda i: d_cols[i])
    same_cols = sorted(s_cols) == sorted(d_cols)
    sk = rows_key([tuple(r[i] for i in order) for r in s_rows])
    dk = rows_key([tuple(r[i] for i in dorder) for r in d_rows]) if same_cols else None
    ok = same_cols and sk == dk
    print(f"{'OK ' if ok else 'BAD'} {name:28s} spark={len(s_rows):7d} duck={len(d_rows):7d} "
          f"cols={'same' if same_cols else (s_cols, d_cols)} t_spark={t1-t0:5.1f}s t_duck={t2-t1:4.1f}s"
          + (f" TYPES {types}" if types else ""), flush=True)
    if not ok and same_cols:
        a, b = set(sk), set(dk)
        for x in list(a - b)[:3]:
            print("   spark only:", x)
        for x in list(b - a)[:3]:
            print("   duck  only:", x)
    return ok


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    import __spark_entry__ as E
    from visitstat.session import build_session
    spark = build_session()
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = []
    for name in (names or list(qs)):
        if name not in sqls:
            print(f"--  {name}: no oracle")
            continue
        try:
            if not compare(spark, con, name, qs[name], sqls[name], sf_dir):
                bad.append(name)
        except Exception as e:  # report and go on
            print(f"ERR {name}: {type(e).__name__}: {str(e)[:800]}")
            bad.append(name)
    print("FAILED:", bad if bad else "none")
    spark.stop()


if __name__ == "__main__":
    main()
