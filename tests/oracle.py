"""Strict comparison of a Spark result with the oracle database's."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb

DATA = os.environ.get("GRAINGUARD_DATA", "/root/testdata")
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


# How the two engines name the same type.
_FAMILY = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "array<string>": "VARCHAR[]",
}


def compare(df, con, sql: str) -> str | None:
    """None when columns, types and rows agree, else what differs."""
    res = con.execute(sql)
    theirs = {d[0]: str(d[1]) for d in res.description}
    names = sorted(theirs)
    if sorted(df.columns) != names:
        return f"columns {sorted(df.columns)} != {names}"
    ours = {n: _FAMILY.get(t, t.upper()) for n, t in df.dtypes}
    bad = {n: (ours[n], theirs[n]) for n in names if ours[n] != theirs[n]}
    if bad:
        return f"types {bad}"
    order = list(theirs)
    a = sorted((tuple(_plain(r[order.index(n)]) for n in names) for r in res.fetchall()), key=repr)
    b = sorted((tuple(_plain(r[n]) for n in names) for r in df.select(*names).collect()), key=repr)
    if len(a) != len(b):
        return f"rows {len(b)} != {len(a)}"
    for x, y in zip(a, b):
        if x != y:
            return f"{names}: ours {y} != theirs {x}"
    return None
