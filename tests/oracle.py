"""Runs a registered query and its SQL on the same files and compares names, rows and values."""

from __future__ import annotations

import datetime as dt
import math
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(folder, f"{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


KINDS = {"bigint": "int", "int": "int", "integer": "int", "smallint": "int", "double": "double", "string": "text", "varchar": "text",
         "date": "date", "boolean": "bool", "timestamp": "timestamp", "timestamp_ntz": "timestamp", "float": "double"}


def _kind(name: str) -> str:
    return KINDS.get(name.lower(), name.lower())


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: [(v is not None, str(type(v)), v) if not isinstance(v, (int, float)) else (True, "n", v) for v in r])


def compare(spark, run, sql: str, folder: str) -> list[str]:
    """Differences as text; empty when the two sides agree exactly."""
    df = run(spark, folder)
    got = [tuple(r) for r in df.collect()]
    cur = connect(folder).execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    kinds = {n: _kind(str(d[1])) for n, d in zip(names, cur.description)}
    odd = {f.name: (f.dataType.simpleString(), kinds[f.name]) for f in df.schema if _kind(f.dataType.simpleString()) != kinds[f.name]}
    if odd:
        return [f"types {odd}"]
    a, b = _rows(df.columns, got), _rows(names, want)
    if len(a) != len(b):
        return [f"{len(a)} rows != {len(b)}"]
    return [f"{x} != {y}" for x, y in zip(a, b) if x != y]
