"""Run registered Spark queries and their DuckDB oracle SQL side by side.

Compares row count, column names and an order-insensitive value digest the
way the driver does. Usage: python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def digest(df: pd.DataFrame) -> str:
    cols = sorted(df.columns)
    rows = sorted(repr(tuple(_norm(r[c]) for c in cols)) for r in df.to_dict("records"))
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()


def to_pandas_spark(sdf) -> pd.DataFrame:
    rows = [r.asDict(recursive=True) for r in sdf.collect()]
    return pd.DataFrame(rows, columns=sdf.columns)


def to_pandas_duck(con, sql: str) -> pd.DataFrame:
    rel = con.sql(sql)
    cols = rel.columns
    return pd.DataFrame([dict(zip(cols, r)) for r in rel.fetchall()], columns=cols)


#: No query may pair all rows or leave the JVM row by row.
BAD_NODES = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


def compare(spark, sf_dir: str, names=None, verbose=True) -> dict:
    from touchline.plans.catalog import ORACLE, QUERIES
    con = duck(sf_dir)
    out = {}
    for name in names or sorted(QUERIES):
        t0 = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            plan = df._jdf.queryExecution().executedPlan().toString()
            if found := [n for n in BAD_NODES if n in plan]:
                raise AssertionError(f"plan has {found}")
            s = to_pandas_spark(df)
        except Exception as e:  # noqa: BLE001
            out[name] = {"ok": False, "error": f"spark: {e}"[:800]}
            if verbose:
                print(name, out[name])
            continue
        t1 = time.time()
        if name not in ORACLE:
            out[name] = {"ok": None, "rows": len(s), "spark_s": round(t1 - t0, 2)}
            if verbose:
                print(name, out[name])
            continue
        try:
            d = to_pandas_duck(con, ORACLE[name])
        except Exception as e:  # noqa: BLE001
            out[name] = {"ok": False, "error": f"duckdb: {e}"[:800]}
            if verbose:
                print(name, out[name])
            continue
        res = {"rows": (len(s), len(d)), "cols_equal": sorted(s.columns) == sorted(d.columns),
               "spark_s": round(t1 - t0, 2)}
        res["hash_equal"] = res["cols_equal"] and digest(s) == digest(d)
        res["ok"] = res["hash_equal"] and len(s) == len(d)
        if not res["cols_equal"]:
            res["cols"] = (sorted(s.columns), sorted(d.columns))
        elif not res["ok"] and verbose:
            cols = sorted(s.columns)
            ss = set(repr(tuple(_norm(r[c]) for c in cols)) for r in s.to_dict("records"))
            dd = set(repr(tuple(_norm(r[c]) for c in cols)) for r in d.to_dict("records"))
            res["only_spark"] = sorted(ss - dd)[:3]
            res["only_duck"] = sorted(dd - ss)[:3]
        out[name] = res
        if verbose:
            print(name, res, flush=True)
    return out


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from touchline.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = build_session("local[8]", 8)
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v.get("ok") is False]
    print("FAILED:", bad)
    print(f"{sum(1 for v in res.values() if v.get('ok'))}/{len(res)} equal")
