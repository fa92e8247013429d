"""Comparing a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

from millrace.sources.tables import SCHEMAS


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, float):
        return repr(x)
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    return str(x)


def oracle_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    with duckdb.connect() as db:
        for name in SCHEMAS:
            path = Path(sf_dir, f"{name}.parquet")
            if path.exists():
                db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
        found = db.execute(sql)
        return [c[0] for c in found.description], found.fetchall()


def same(df, sql: str, sf_dir: str) -> None:
    names, expected = oracle_rows(sql, sf_dir)
    assert sorted(names) == sorted(df.columns)
    order = [df.columns.index(c) for c in sorted(names)]
    got = sorted(tuple(plain(r[i]) for i in order) for r in df.collect())
    order = [names.index(c) for c in sorted(names)]
    want = sorted(tuple(plain(r[i]) for i in order) for r in expected)
    assert len(got) == len(want)
    assert got == want
