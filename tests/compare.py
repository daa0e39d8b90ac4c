"""Order-free comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import datetime as dt
import os
from collections import Counter
from decimal import Decimal

import duckdb


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def _plain(value):
    if isinstance(value, (float, Decimal)):
        return None if value != value else round(float(value), 6) + 0.0
    if isinstance(value, dt.datetime) and value.time() == dt.time():
        return value.date()
    return tuple(map(_plain, value)) if isinstance(value, list) else value


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(_plain(r[k]) for k in order) for r in rows)


def assert_equal(spark_result, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(spark_result.columns) == sorted(names)
    a, b = bag(spark_result.columns, spark_result.collect()), bag(names, found.fetchall())
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
