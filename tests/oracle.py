"""Holds a query's rows against those of its SQL in DuckDB."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb

SMALL = "/root/testdata/sf0.001"


def duck(sf_dir: str = SMALL) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    """A value that both engines give alike."""
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, Decimal)):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return [plain(x) for x in v.values()]
    return str(v)


def rows(columns, data) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=repr)


def assert_same(df, sql: str, sf_dir: str = SMALL) -> None:
    found = duck(sf_dir).execute(sql)
    want_columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(want_columns)
    got, want = rows(df.columns, df.collect()), rows(want_columns, found.fetchall())
    assert len(got) == len(want)
    different = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not different, different[:3]
