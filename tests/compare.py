"""Compare a query with its SQL on DuckDB, as sorted rows."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c


def _text(v: object) -> str:
    if v is None or pd.isna(v):
        return "null"
    return f"{v:.6f}" if isinstance(v, float) else str(v)


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    cols = sorted(frame.columns)
    return sorted(tuple(_text(v) for v in r) for r in frame[cols].itertuples(index=False))


def same(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> None:
    assert sorted(spark_frame.columns) == sorted(sql_frame.columns)
    left, right = rows(spark_frame), rows(sql_frame)
    assert len(left) == len(right)
    # integers that hold nulls are floats in one of the frames
    tidy = lambda rs: [tuple(x.removesuffix(".000000") for x in r) for r in rs]
    assert tidy(left) == tidy(right)
