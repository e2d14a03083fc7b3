"""Compares queries with their SQL twins as the driver does: columns by name, rows in any order, values to 9 digits."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return db


def _value(x):
    if isinstance(x, (bool, str)) or x is None:
        return x
    if isinstance(x, (int, float, decimal.Decimal)):
        return "nan" if x != x else float(f"{float(x):.9g}") + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(map(_value, x))
    return str(x)


def rows(columns: list[str], data) -> tuple[list[str], list]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_value(r[i]) for i in order) for r in data), key=repr)


def difference(df, db: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    got = rows(df.columns, df.collect())
    found = db.execute(sql)
    want = rows([d[0] for d in found.description], found.fetchall())
    if got == want:
        return None
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    extra = [r for r in got[1] if r not in set(want[1])][:2]
    missing = [r for r in want[1] if r not in set(got[1])][:2]
    return f"{len(got[1])} and {len(want[1])} rows; {extra} and {missing}"
