"""Rows of a DataFrame and of DuckDB, made comparable."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = Path(folder, f"{t}.parquet")
        con.execute(f"create view {t} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, list | tuple):
        return tuple(plain(y) for y in x)
    return x


def rows(names: list[str], values: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


def of_spark(df: DataFrame) -> tuple[list[str], list[tuple]]:
    return rows(df.columns, [tuple(r) for r in df.collect()])


def of_sql(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    got = con.execute(sql)
    return rows([d[0] for d in got.description], got.fetchall())
