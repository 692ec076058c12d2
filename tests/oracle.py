"""Run a query beside its SQL in DuckDB over the same tables."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def rows(frame) -> list[str]:
    columns = sorted(frame.columns)
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(map(repr, plain.itertuples(index=False, name=None)))


def assert_matches(spark, query, sql: str, sf_dir: str) -> None:
    mine, other = query(spark, sf_dir).toPandas(), connect(sf_dir).execute(sql).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert rows(mine) == rows(other)
