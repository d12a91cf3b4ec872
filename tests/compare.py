"""Run a query in Spark and its SQL in DuckDB and compare rows regardless of order."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if value is None or value is pd.NA or value is pd.NaT:
        return None
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return repr(value + 0.0)
    if hasattr(value, "item"):
        return _plain(value.item())
    return value


def _rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: tuple(str(v) for v in r))


def differences(df, sql: str, con: duckdb.DuckDBPyConnection) -> str | None:
    """None when both sides agree, else what differs first."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = _rows(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for a, b in zip(got, want, strict=True):
        if a != b:
            return f"{sorted(names)}\n spark {a}\n sql   {b}"
    return None
