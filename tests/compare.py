"""Comparison of a query with its SQL: names, row count, and values irrespective of order."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def _normal(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_value(row[i]) for i in order) for row in rows]
    return sorted(out, key=repr)


def differences(df, con, sql: str) -> list[str]:
    relation = con.sql(sql)
    columns = list(relation.columns)
    if sorted(df.columns) != sorted(columns):
        return [f"columns {sorted(df.columns)} != {sorted(columns)}"]
    left = _normal(df.columns, df.collect())
    right = _normal(columns, relation.fetchall())
    if len(left) != len(right):
        return [f"{len(left)} rows != {len(right)}"]
    wrong = [f"{a} != {b}" for a, b in zip(left, right) if a != b]
    types = [
        f"types differ in {n}: {type(a)} {type(b)}"
        for row_a, row_b in zip(left[:50], right[:50])
        for n, a, b in zip(sorted(columns), row_a, row_b)
        if a is not None and b is not None and type(a) is not type(b)
    ]
    return ([f"{len(wrong)} rows differ"] + wrong[:5] if wrong else []) + types[:3]
