"""Run a registered query and its SQL twin and compare the rows."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    return value


def bag(rows, columns: list[str]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def kinds(rows, columns: list[str]) -> dict[str, set[str]]:
    """Python types seen per column; tells integers from floats and text from numbers."""
    return {c: {type(r[i]).__name__ for r in rows if r[i] is not None} for i, c in enumerate(columns)}


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both give the same rows, else what differs."""
    got = df.collect()
    relation = con.sql(sql)
    want = relation.fetchall()
    if sorted(df.columns) != sorted(relation.columns):
        return f"columns {df.columns} != {relation.columns}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    if kinds(got, df.columns) != kinds(want, relation.columns):
        return f"types {kinds(got, df.columns)} != {kinds(want, relation.columns)}"
    left, right = bag(got, df.columns), bag(want, relation.columns)
    if left != right:
        a, b = next(iter((left - right).items())), next(iter((right - left).items()))
        return f"{sum((left - right).values())} rows differ, e.g.\n{a}\n{b}"
    return None
