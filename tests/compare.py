"""Run a query and its SQL side by side and compare the rows."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if hasattr(v, "as_tuple"):
        return norm(float(v))
    return v


def rows(cols: list[str], data) -> Counter:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in data)


def compare(spark, name: str, query, sql: str, sf_dir: str) -> str | None:
    """None if equal, else what differs."""
    got = query(spark, sf_dir)
    con = connect(sf_dir)
    want = con.execute(sql)
    cols = [d[0] for d in want.description]
    if sorted(cols) != sorted(got.columns):
        return f"columns {sorted(got.columns)} against {sorted(cols)}"
    a, b = rows(got.columns, [tuple(r) for r in got.collect()]), rows(cols, want.fetchall())
    if a != b:
        close = _close(a, b)
        if not close:
            return f"{sum(a.values())} rows against {sum(b.values())}; only Spark: {list((a - b).items())[:3]}; only SQL: {list((b - a).items())[:3]}"
    return None


def _close(a: Counter, b: Counter) -> bool:
    x, y = a - b, b - a
    if sum(x.values()) != sum(y.values()):
        return False
    key = lambda r: tuple(str(v) if not isinstance(v, float) else f"{v:.5g}" for v in r)
    for p, q in zip(sorted(x.elements(), key=key), sorted(y.elements(), key=key), strict=True):
        for u, v in zip(p, q, strict=True):
            if isinstance(u, (int, float)) and isinstance(v, (int, float)):
                if not math.isclose(u, v, rel_tol=1e-7, abs_tol=1e-7):
                    return False
            elif u != v:
                return False
    return True
