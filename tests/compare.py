"""Compare a Spark result with a DuckDB result: column names, row count and order-free values."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        if math.isnan(value):
            return None
        return f"{value:.12g}" if value != int(value) or abs(value) > 1e15 else str(int(value))
    if isinstance(value, int):
        return str(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day).isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(str(_plain(v)) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{_plain(v)}" for k, v in sorted(value.items())) + "}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("\0" if _plain(r[i]) is None else _plain(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str) -> str | None:
    """None when the results agree, else a short description."""
    got = [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    for left, right in zip(a, b):
        if left != right:
            bad = sum(x != y for x, y in zip(a, b))
            return f"{bad}/{len(a)} rows differ; spark {left} != sql {right} ({sorted(names)})"
    return None
