"""Run registered queries next to their SQL in DuckDB and compare values.

    python tools_verify.py [-s sf0.01] [name-prefix ...]
"""

import sys
import time

import duckdb
import pandas as pd

from catalog import ORACLES, QUERIES
from sigloom.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or str(df[c].dtype) in ("str", "string"):
            df[c] = df[c].map(lambda v: "~" if v is None or v != v else str(v)).astype(object)
        elif str(df[c].dtype).startswith(("bool",)):
            df[c] = df[c].astype(str)
        else:
            df[c] = df[c].astype(float).round(9).add(0.0)
    return df.sort_values(list(df.columns), kind="mergesort").reset_index(drop=True)


def main(argv):
    sf = "sf0.01"
    if argv[:1] == ["-s"]:
        sf, argv = argv[1], argv[2:]
    folder = f"/root/testdata/{sf}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    bad = []
    for name, fn in QUERIES.items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        t0 = time.time()
        try:
            got = fn(spark, folder).toPandas()
            spent = time.time() - t0
            if name not in ORACLES:
                print(f"rows  {name:32s} {len(got):7d} {spent:6.1f}s")
                continue
            t1 = time.time()
            want = con.execute(ORACLES[name]).df()
            a, b = canonical(got), canonical(want)
            if list(a.columns) != list(b.columns):
                why = f"columns {list(a.columns)} vs {list(b.columns)}"
            elif len(a) != len(b):
                why = f"rows {len(a)} vs {len(b)}"
            elif not a.equals(b):
                diff = (a != b) & ~(a.isna() & b.isna())
                row = diff.any(axis=1).idxmax() if diff.any().any() else -1
                why = f"{int(diff.any(axis=1).sum())} rows differ; first\n{a.loc[row].to_dict()}\n{b.loc[row].to_dict()}"
            else:
                why = ""
            empty = "" if len(a) else "  EMPTY"
            print(f"{'FAIL' if why else 'ok  '}  {name:32s} {len(got):7d} {spent:6.1f}s {time.time() - t1:5.1f}s {why}{empty}", flush=True)
            if why:
                bad.append(name)
        except Exception as exc:  # report and go on
            bad.append(name)
            print(f"ERR   {name:32s} {type(exc).__name__}: {str(exc)[:600]}", flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
