"""Compares a registered query with its DuckDB oracle, value by value."""

import glob
import os

import duckdb
import pandas as pd


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


def text(x: object) -> str:
    if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
        return ""
    if hasattr(x, "isoformat"):
        return pd.Timestamp(x).isoformat()
    if isinstance(x, (bool, str)):
        return str(x)
    return f"{round(float(x), 6) + 0.0:.9g}"


def rows(frame: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(text(x) for x in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


def same(spark, query, sql: str, sf_dir: str) -> int:
    mine, theirs = query(spark, sf_dir).toPandas(), connection(sf_dir).execute(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    a, b = rows(mine), rows(theirs)
    assert len(a) == len(b)
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not wrong, wrong[:3]
    return len(a)
