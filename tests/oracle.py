"""Compares a registered query with its SQL in DuckDB over the same tables, value by value."""

import math
import os
from decimal import Decimal

import duckdb

DATA = os.environ.get("QUILLON_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    """A value that compares as it reads: numbers by their value whatever their type, but never equal to true or text."""
    if value is None or isinstance(value, bool | str):
        return (type(value).__name__, value)
    if isinstance(value, int | Decimal):
        return ("number", Decimal(value).normalize())
    if isinstance(value, float):
        return ("number", Decimal(repr(value)).normalize()) if math.isfinite(value) else ("number", repr(value))
    if isinstance(value, bytes | bytearray):
        return ("bytes", bytes(value))
    if isinstance(value, dict):
        return ("map", sorted((plain(k), plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return ("map", sorted((plain(k), plain(v)) for k, v in value.asDict().items()))
    if isinstance(value, list | tuple):
        return ("list", [plain(x) for x in value])
    return (type(value).__name__, value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(str([plain(r[i]) for i in order]) for r in rows)


def same(spark, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    frame, told = query(spark, DATA), con.execute(sql)
    found = rows_of(frame.columns, frame.collect())
    expected = rows_of([c[0] for c in told.description], told.fetchall())
    assert found[0] == expected[0]
    assert found[1] == expected[1] and expected[1]
