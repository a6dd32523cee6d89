"""Runs a registered query and its SQL and compares what they give."""

from __future__ import annotations

import datetime
import decimal

import duckdb
from workload.adapters import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return value


def _kind(name: str) -> str:
    name = name.lower()
    if "int" in name:
        return "int"
    if name.startswith(("double", "float", "decimal")):
        return "float"
    return {"varchar": "string"}.get(name, name)


def differences(frame, connection, sql: str) -> list[str]:
    """Human-readable differences, empty if both give the same rows, names and kinds."""
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: _kind(str(d[1])) for d in cursor.description}
    found = []
    if sorted(names) != sorted(frame.columns):
        return [f"columns {sorted(frame.columns)} / {sorted(names)}"]
    for column, kind in frame.dtypes:
        if _kind(kind) != kinds[column] and kinds[column] != "null":
            found.append(f"type of {column}: {kind} / {kinds[column]}")
    order = sorted(names)
    place = [names.index(c) for c in order]
    left = sorted(repr(tuple(_plain(row[c]) for c in order)) for row in frame.collect())
    right = sorted(repr(tuple(_plain(row[i]) for i in place)) for row in cursor.fetchall())
    if len(left) != len(right):
        found.append(f"rows {len(left)} / {len(right)}")
    only_left, only_right = set(left) - set(right), set(right) - set(left)
    for label, rows in (("spark", only_left), ("sql", only_right)):
        found += [f"only in {label} ({len(rows)}): {row[:400]}" for row in sorted(rows)[:3]]
    return found
