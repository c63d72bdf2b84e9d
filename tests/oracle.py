"""Compares a query with its SQL on DuckDB, as sorted rows with rounded floats."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            path = f"{folder}/{name}"
            con.execute(f"create view {name[:-8]} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def _plain(x) -> str:
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
        return "null"
    if isinstance(x, float):
        return f"{x + 0.0:.4f}"
    return str(x.tolist() if hasattr(x, "tolist") else x)


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(_plain(x) for x in row) for row in frame.itertuples(index=False))


def same(con, query, sql: str) -> None:
    mine, other = query.toPandas(), con.execute(sql).df()
    assert sorted(mine.columns) == sorted(other.columns)
    a, b = rows_of(mine), rows_of(other)
    assert len(a) == len(b)
    differ = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not differ, differ[:3]
