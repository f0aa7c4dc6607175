"""Run registered queries next to their SQL in DuckDB and compare names, counts and values.

    python -m tests.oracle [sf] [name-prefix ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from datetime import date, datetime

import duckdb

DATA = "/root/testdata"


def duck(sf_dir: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(_norm(x) for x in v.values())
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, date):
        return v.isoformat()
    return v


def _rows(rows, order):
    return sorted((tuple(_norm(r[c]) for c in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    want = rel.fetchall()
    got = df.collect()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    pairs = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for n, t in df.dtypes:
        if pairs.get(t, types[n]) != types[n]:
            return f"type of {n}: {t} vs {types[n]}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    order = sorted(names)
    pos = [names.index(c) for c in order]
    a = _rows([r.asDict(recursive=False) for r in got], order)
    b = _rows(want, pos)
    for x, y in zip(a, b):
        if x != y:
            return f"values {dict(zip(order, x))} vs {dict(zip(order, y))}"
    return None if got else "empty"


def main() -> None:
    from tractloom.plans import catalog
    from tractloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    spark = local_session("8")
    path = f"{DATA}/sf{sf}"
    con = duck(path)
    con.execute("SET threads=8")
    bad = 0
    for name, fn in catalog.QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            sql = catalog.ORACLE.get(name)
            if sql:
                diff = compare(fn(spark, path), con, sql)
            else:
                n = fn(spark, path).count()
                diff = None if n else "empty"
        except Exception as e:  # report and go on with the next query
            diff = f"{type(e).__name__}: {str(e)[:600]}"
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'DIFF'} {name} {time.time() - t:.1f}s"
              f"{'' if catalog.ORACLE.get(name) else ' (no sql)'} {diff or ''}", flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main()
