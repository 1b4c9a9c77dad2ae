"""Side-by-side check of a registered query against its DuckDB oracle.

Mirrors the driver's gate: same row count, same column names, and the same
multiset of rows (columns sorted by name, floats compared as rounded values).
Run as a script to check every key: ``python tests/oracle_compare.py [sf_dir] [key ...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

VIEWS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
         "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in VIEWS:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


EXACT = os.environ.get("ORACLE_EXACT") == "1"   # compare floats bit for bit


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if EXACT else round(v, 6)
    if isinstance(v, dict):
        return tuple(sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(df_pandas) -> list[tuple]:
    cols = sorted(df_pandas.columns)
    out = []
    for rec in df_pandas[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(None if (isinstance(x, float) and math.isnan(x)) else x) if not hasattr(x, "tolist")
                         else _norm(x.tolist()) for x in rec))
    return sorted(out, key=repr)


def compare(spark, key: str, sf_dir: str, con=None) -> dict:
    from __spark_entry__ import oracle_sql, queries
    con = con or duck(sf_dir)
    t = time.time()
    sdf = queries()[key](spark, sf_dir)
    sp = sdf.toPandas()
    t_spark = time.time() - t
    sql = oracle_sql().get(key)
    res = {"key": key, "spark_rows": len(sp), "spark_sec": round(t_spark, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    dp = con.execute(sql).df()
    res["oracle_rows"] = len(dp)
    if sorted(sp.columns) != sorted(dp.columns):
        res["status"] = f"columns differ: {sorted(sp.columns)} vs {sorted(dp.columns)}"
        return res
    ta = {c: str(sp[c].dtype) for c in sp.columns}
    tb = {c: str(dp[c].dtype) for c in dp.columns}
    if ta != tb:
        res["dtypes"] = {c: (ta[c], tb[c]) for c in ta if ta[c] != tb[c]}
    a, b = rows_of(sp), rows_of(dp)
    if a == b and "dtypes" not in res:
        res["status"] = "match"
    elif a == b:
        res["status"] = "dtype mismatch"
    else:
        sa, sb = set(a), set(b)
        res["status"] = "value mismatch"
        res["only_spark"] = [r for r in a if r not in sb][:3]
        res["only_oracle"] = [r for r in b if r not in sa][:3]
    return res


if __name__ == "__main__":
    from hybridlake.session import local_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:]
    spark = local_session(8)
    from __spark_entry__ import queries
    con = duck(sf)
    bad = 0
    for k in keys or list(queries()):
        try:
            r = compare(spark, k, sf, con)
        except Exception as e:  # noqa: BLE001
            r = {"key": k, "status": f"error: {type(e).__name__}: {str(e)[:400]}"}
        if r["status"] not in ("match", "rows-only"):
            bad += 1
        print(r, flush=True)
    print("mismatches:", bad)
