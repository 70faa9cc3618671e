"""Run registered queries in Spark and their oracle SQL in DuckDB; compare results.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Mirrors the driver's check: row count, column names, order-insensitive values.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


STRICT = os.environ.get("ORACLE_STRICT") == "1"


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v) if STRICT else float(f"{v:.9g}")
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _key(row):
    return tuple((0, "") if x is None else (1, str(x)) for x in row)


def compare(sdf, con, sql):
    # Rows as both engines give them: a frame would turn integers with nulls into floats.
    ran = con.execute(sql)
    d_names, d_rows = [c[0] for c in ran.description], ran.fetchall()
    s_rows = [tuple(r) for r in sdf.collect()]
    s_cols, d_cols = sorted(sdf.columns), sorted(d_names)
    if s_cols != d_cols:
        return False, f"columns differ: spark={s_cols} duck={d_cols}"
    if len(s_rows) != len(d_rows):
        return False, f"rows differ: spark={len(s_rows)} duck={len(d_rows)}"
    srows, drows = (sorted((tuple(_norm(r[names.index(c)]) for c in s_cols) for r in rows), key=_key)
                    for names, rows in ((sdf.columns, s_rows), (d_names, d_rows)))
    bad = 0
    first = None
    for a, b in zip(srows, drows):
        if a != b:
            bad += 1
            first = first or (a, b)
    if bad:
        return False, f"{bad} rows differ; first: spark={first[0]} duck={first[1]}"
    return True, f"{len(s_rows)} rows"


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and os.path.isdir(argv[1]) else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not os.path.isdir(a)]
    import __spark_entry__ as E
    from retentio.session import get_session
    spark = get_session()
    qs, ors = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    ok_all = True
    for name in names or list(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            if name in ors:
                ok, msg = compare(df, con, ors[name])
            else:
                n = df.count()
                ok, msg = True, f"rows-only: {n} rows"
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:400]}"
        ok_all &= ok
        print(f"{'OK  ' if ok else 'FAIL'} {name:32s} {time.time() - t0:6.1f}s  {msg}", flush=True)
    return 0 if ok_all else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv))
