"""Runs a query in Spark and its SQL in DuckDB over the same folder and compares their rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

DATA = "/root/testdata"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, query, sql, folder):
    df = query(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows_of([x[0] for x in cur.description], cur.fetchall())
    assert got[0] == want[0], f"{name}: columns {got[0]} and {want[0]}"
    assert len(got[1]) == len(want[1]), f"{name}: {len(got[1])} and {len(want[1])} rows"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    assert not bad, f"{name}: {len(bad)} of {len(want[1])} rows differ, such as {bad[:2]}"
    return len(want[1])
