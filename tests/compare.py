"""Compares a query's rows with those of its SQL in DuckDB, as the value-hash check does."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def _cell(x) -> str:
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return "~"
    if hasattr(x, "strftime"):
        return x.strftime("%Y-%m-%d %H:%M:%S")
    if isinstance(x, str):
        return x
    return str(bool(x)) if type(x).__name__.startswith("bool") else f"{float(x):.9g}"


def canonical(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted(frame[columns].astype(object).map(_cell).itertuples(index=False, name=None))


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    a, b = canonical(got), canonical(want)
    only = (sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3])
    assert a == b, f"{len(a)} and {len(b)} rows; only here {only[0]}, only in SQL {only[1]}"
