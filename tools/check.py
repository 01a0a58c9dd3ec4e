"""Compare registered queries with their SQL in DuckDB: python tools/check.py [--dir DIR] [name or prefix ...]"""

from __future__ import annotations

import argparse
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

from quern import plans
from quern.registry import ORACLES, QUERIES, TABLES
from quern.session import local_session


def kind(s: pd.Series) -> str:
    s = s.dropna()
    if s.empty:
        return "empty"
    if pd.api.types.is_bool_dtype(s):
        return "b"
    if s.dtype == object:
        return type(s.iloc[0]).__name__
    return s.dtype.kind


def canon(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "Mm":
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NA else (str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)))
        elif df[c].dtype.kind in "iuf" or str(df[c].dtype).startswith(("Int", "Float")):
            df[c] = df[c].astype("float64")
    key = df.astype(str).agg("\x1f".join, axis=1) if len(df) else pd.Series([], dtype=str)
    return df.iloc[key.argsort(kind="stable").to_numpy()].reset_index(drop=True) if len(df) else df


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--dir", default="/root/testdata/sf0.01")
    ap.add_argument("--after", default="")
    ap.add_argument("--module", default="")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    if a.module:
        import importlib

        for m in a.module.split(","):
            importlib.import_module(f"quern.plans.{m}")
    else:
        plans.load()
    spark = local_session(8)
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{a.dir}/{t}.parquet'")
    bad = []
    names = [n for n in QUERIES if not a.names or any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in a.names)]
    for n in names:
        t0 = time.time()
        try:
            got = QUERIES[n](spark, a.dir).toPandas()
            sec = time.time() - t0
            if n not in ORACLES:
                print(f"ROWS {n}: {len(got)} rows, {sec:.1f}s", flush=True)
                continue
            want = con.execute(ORACLES[n]).df()
            problems = []
            if sorted(got.columns) != sorted(want.columns):
                problems.append(f"columns {sorted(got.columns)} vs {sorted(want.columns)}")
            elif len(got) != len(want):
                problems.append(f"rows {len(got)} vs {len(want)}")
            else:
                for c in got.columns:
                    k1, k2 = kind(got[c]), kind(want[c])
                    if k1 != k2 and "empty" not in (k1, k2) and not (got[c].isna().any() and {k1, k2} <= {"i", "f"}) and {k1, k2} != {"list", "ndarray"}:
                        problems.append(f"type {c}: {k1} vs {k2}")
                g, w = canon(got), canon(want)
                for c in g.columns:
                    neq = ~((g[c] == w[c]) | (g[c].isna() & w[c].isna()))
                    if neq.any():
                        i = neq.idxmax()
                        problems.append(f"{int(neq.sum())} values of {c}, first {g[c][i]!r} vs {w[c][i]!r} at {dict(g.loc[i].iloc[:5])}")
            if len(got) == 0:
                problems.append("no rows")
            nulls = [c for c in got.columns if len(got) and got[c].isna().all()]
            note = f" all-null {nulls}" if nulls else ""
            if problems:
                bad.append(n)
                print(f"BAD  {n}: " + "; ".join(p[:600] for p in problems[:4]), flush=True)
            else:
                print(f"ok   {n}: {len(got)} rows, {sec:.1f}s{note}", flush=True)
        except Exception as e:
            bad.append(n)
            text = str(e).split("JVM stacktrace")[0]
            where = [l for l in traceback.format_exc().splitlines() if "/root/repo" in l][-1:]
            print(f"ERR  {n}: {type(e).__name__} {text[:500]} {where}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
