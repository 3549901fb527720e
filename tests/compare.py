"""Holding a query's rows against DuckDB's on the same files."""

from __future__ import annotations

import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return str(value) if isinstance(value, Decimal) else value


def rows_of(columns: list[str], rows) -> tuple[list[str], list[str]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr(tuple(_plain(r[i]) for i in order)) for r in rows)


def assert_same(frame, sql: str, con: duckdb.DuckDBPyConnection) -> None:
    found = con.sql(sql)
    expected = rows_of(found.columns, found.fetchall())
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == expected
