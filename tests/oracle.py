"""Holds a query's rows against those of its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def rows_of(table) -> Counter:
    names = sorted(table.column_names)
    return Counter(tuple(map(_plain, r)) for r in zip(*(table.column(c).to_pylist() for c in names)))


def sql_rows(sql: str, d: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{d}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return con.execute(sql).to_arrow_table()


def difference(df, sql: str, d: str) -> str:
    """Empty if the rows are the same, else what differs."""
    got, want = df.toArrow(), sql_rows(sql, d)
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {got.column_names} and {want.column_names}"
    a, b = rows_of(got), rows_of(want)
    if a == b:
        return ""
    return f"{sum((a - b).values())} of {got.num_rows} rows only in Spark's, {sum((b - a).values())} of {want.num_rows} only in SQL's, such as {list((a - b).items())[:2]} and {list((b - a).items())[:2]}"
