"""Run registered queries on Spark and their SQL on DuckDB and compare the results.

    python compare.py [--sf 0.01] [--hot-rows N] [name ...]
"""

from __future__ import annotations

import argparse
import math
import time

import duckdb

from pointprep.registry import ORACLES, QUERIES
from pointprep.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return "" if v is None else str(v)


KIND = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}


def difference(df, con, text: str) -> tuple[int, str | None]:
    """Row count and the first difference, or None when both results are equal."""
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(text)
    theirs = dict(zip(rel.columns, [str(t) for t in rel.types]))
    if sorted(theirs) != cols:
        return len(got), f"columns {cols} vs {sorted(theirs)}"
    kinds = {c: KIND.get(t, t) for c, t in df.dtypes}
    if kinds != theirs:
        return len(got), f"types {[(c, kinds[c], theirs[c]) for c in cols if kinds[c] != theirs[c]]}"
    at = [rel.columns.index(c) for c in cols]
    want = sorted(tuple(_norm(r[i]) for i in at) for r in rel.fetchall())
    if len(got) != len(want):
        return len(got), f"rows {len(got)} vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return len(got), f"{len(bad)} rows differ ({cols}):\n   spark {bad[0][0]}\n   sql   {bad[0][1]}"
    return len(got), None


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--hot-rows", default=None)
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = local_session(8)
    if args.hot_rows:
        spark.conf.set("pointprep.hotRows", args.hot_rows)
    con = connect(sf_dir)
    failed = []
    for name in args.names or list(QUERIES):
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                n, why = difference(df, con, ORACLES[name])
            else:
                n, why = len(df.collect()), None
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            n, why = -1, f"{type(e).__name__}: {str(e)[:1500]}"
        state = "ok  " if why is None else "FAIL"
        note = "" if name in ORACLES else " (rows only)"
        print(f"{state} {name:22s} rows={n:<7d} {time.time() - start:6.2f}s{note} {why or ''}", flush=True)
        if why:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
