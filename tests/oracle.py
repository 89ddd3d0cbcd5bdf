"""Runs a query and its SQL on the same tables and compares names, row counts and values."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.10g}") + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf, f, sql) -> str:
    """'' if both agree, else what differs."""
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    made = db.execute(sql)
    names, want = [d[0] for d in made.description], made.fetchall()
    df = f(spark, sf)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want = rows_of(names, want)
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    for a, b in zip(got, want, strict=True):
        if a != b:
            return f"{str(a)[:300]} and {str(b)[:300]}"
    return ""
