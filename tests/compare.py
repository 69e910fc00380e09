"""Compare a Spark result with a DuckDB result, ignoring row and column order."""

from __future__ import annotations

import datetime as dt
import decimal
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
DATA = os.environ.get("TALLYSLOT_DATA", "/root/testdata")


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, float):
        return ("float", repr(v))
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, int):
        return ("int", v)
    if isinstance(v, dt.datetime):
        return ("stamp", v.replace(tzinfo=None).isoformat())
    if isinstance(v, dt.date):
        return ("date", v.isoformat())
    return (type(v).__name__, v if v is None else str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql: str) -> list[str]:
    """Empty when both sides agree on columns, types and values."""
    spark_rows = df.collect()
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    duck_rows = result.fetchall()
    out = []
    if sorted(df.columns) != sorted(columns):
        return [f"columns: only spark {set(df.columns) - set(columns)}, only sql {set(columns) - set(df.columns)}"]
    if len(spark_rows) != len(duck_rows):
        out.append(f"rows: spark {len(spark_rows)}, sql {len(duck_rows)}")
    a, b = rows_of(df.columns, spark_rows), rows_of(columns, duck_rows)
    if a != b:
        in_b, in_a = set(b), set(a)
        out.append(f"names: {sorted(columns)}")
        out += [f"only spark: {r}" for r in [r for r in a if r not in in_b][:3]]
        out += [f"only sql:   {r}" for r in [r for r in b if r not in in_a][:3]]
    return out
