"""Run a registered query on Spark and its oracle on DuckDB, and compare values and types."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

from queries.base import RAW
from queries.catalogue import ORACLES, QUERIES


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _key(row):
    return tuple((x is None, type(x).__name__, str(x)) for x in row)


def compare(spark, name: str, sf: str) -> str | None:
    """None when equal, else a description of the first difference."""
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    ours = sorted((tuple(_norm(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=_key)
    if name not in ORACLES:
        return None if ours else "no rows"
    con = duckdb.connect()
    for t in RAW:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    res = con.execute(ORACLES[name])
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return f"columns differ: {cols} vs {sorted(names)}"
    order = [names.index(c) for c in cols]
    theirs = sorted((tuple(_norm(r[i]) for i in order) for r in res.fetchall()), key=_key)
    if len(ours) != len(theirs):
        return f"row counts differ: {len(ours)} vs {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            diff = [(c, x, y) for c, x, y in zip(cols, a, b) if x != y or type(x) is not type(y)]
            return f"first difference: {diff} in {a}"
    return None if ours else "equal but empty"


if __name__ == "__main__":
    from cohortspark.session import local_session

    spark = local_session()
    sf = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:] or list(QUERIES)
    bad = 0
    for q in wanted:
        start = time.time()
        try:
            problem = compare(spark, q, sf)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        took = time.time() - start
        kind = "oracle" if q in ORACLES else "rows"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {q:32s} {kind:7s} {took:6.2f}s {problem or ''}", flush=True)
    print(f"{len(wanted) - bad}/{len(wanted)} ok")
