"""Run registered queries beside their SQL on the given tables and report differences."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        frame[c] = frame[c].map(
            lambda v: "NULL"
            if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA
            else (repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
        )
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def oracle(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def compare(spark, con, folder: str, name: str, entry) -> str:
    got = entry.run(spark, folder).toPandas()
    if entry.sql is None:
        return f"rows only ({len(got)})"
    want = con.execute(entry.sql).fetchdf()
    if sorted(got.columns) != sorted(want.columns):
        return f"DIFF columns {sorted(got.columns)} / {sorted(want.columns)}"
    a, b = normal(got), normal(want)
    if len(a) != len(b):
        return f"DIFF rows {len(a)} / {len(b)}"
    if not a.equals(b):
        bad = (a != b).any(axis=1)
        return f"DIFF values in {int(bad.sum())} of {len(a)} rows\n{a[bad].head(4).to_string()}\n{b[bad].head(4).to_string()}"
    kinds = [f"{c}:{got[c].dtype}/{want[c].dtype}" for c in got.columns if got[c].dtype != want[c].dtype]
    return f"ok {len(a)} rows" + (f"  [types {kinds}]" if kinds else "")


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--dir", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from quire.plans import load_all
    from quire.session import build_session

    registry = load_all()
    spark = build_session("check")
    con = oracle(args.dir)
    bad = 0
    for name, entry in registry.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            result = compare(spark, con, args.dir, name, entry)
        except Exception as e:  # report and go on with the next query
            result = "ERROR " + str(e)[:900]
        bad += result.startswith(("DIFF", "ERROR"))
        print(f"{name:42s} {time.time() - start:6.2f}s {result}", flush=True)
    print("bad:", bad)
    sys.exit(bad > 0)


if __name__ == "__main__":
    main()
