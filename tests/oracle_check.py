"""Run registered queries in Spark and their SQL in DuckDB, compare results.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    import pandas as pd

    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(table):
    """Sorted rows of an Arrow table, where NULL and NaN stay apart."""
    cols = sorted(table.column_names)
    out = [tuple(_norm(x) for x in r) for r in zip(*(table.column(c).to_pylist() for c in cols))]
    return cols, sorted(out, key=repr)


def compare(spark, sf_dir: str, names=None, verbose=True):
    import __spark_entry__ as E

    qs, sql = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    report = {}
    for name in names or qs:
        t0 = time.time()
        sdf = qs[name](spark, sf_dir)
        spdf = sdf.toArrow()
        t1 = time.time()
        if name not in sql:
            report[name] = ("rows-only", spdf.num_rows, round(t1 - t0, 1))
            if verbose:
                print(name, report[name], flush=True)
            continue
        dpdf = con.sql(sql[name]).to_arrow_table()
        sc, sr = rows_of(spdf)
        dc, dr = rows_of(dpdf)
        ok = sc == dc and sr == dr
        detail = ""
        if not ok:
            if sc != dc:
                detail = f"cols {sc} vs {dc}"
            else:
                diff = set(sr) ^ set(dr)
                detail = f"rows {len(sr)} vs {len(dr)}; {len(diff)} differ e.g. {sorted(diff, key=repr)[:4]}"
        report[name] = (ok, spdf.num_rows, round(t1 - t0, 1), detail)
        if verbose:
            print(name, report[name], flush=True)
    return report


if __name__ == "__main__":
    from lumenvec.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    rep = compare(spark, sf, sys.argv[2:] or None)
    bad = [k for k, v in rep.items() if v[0] is False]
    print("FAILED:", bad if bad else "none")
