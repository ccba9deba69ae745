"""Runs a query's DuckDB form over the same files and compares values without regard to order."""

from __future__ import annotations

import decimal
import numbers
import os

import duckdb
import pandas as pd


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if value is None or value is pd.NaT or value is pd.NA or isinstance(value, float) and value != value:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, numbers.Number | decimal.Decimal):
        return float(f"{float(value):.9g}")
    return str(value)


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False)), key=str)


def duck(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{name}") else "")
        con.execute(f"create view {name.split('.')[0]} as select * from '{path}'")
    return con.execute(sql).df()


def same(spark, query, sql: str, sf_dir: str) -> None:
    ours, theirs = query(spark, sf_dir).toPandas(), duck(sf_dir, sql)
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
