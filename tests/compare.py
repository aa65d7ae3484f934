"""Comparing a Spark result with DuckDB's, row order aside."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def kind(value) -> str:
    return type(value).__name__


def plain(value):
    if hasattr(value, "as_tuple"):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def sort_key(row):
    return tuple((v is not None, str(type(v)), v) if v is not None else (False, "", "") for v in row)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=sort_key)


def differences(spark_df, sql: str, con, exact: bool = True) -> list[str]:
    """What differs, as readable lines; empty when the results are the same."""
    found = con.execute(sql)
    expected_columns = [d[0] for d in found.description]
    expected = found.fetchall()
    actual_columns = spark_df.columns
    actual = spark_df.collect()
    if sorted(expected_columns) != sorted(actual_columns):
        return [f"columns: {sorted(actual_columns)} against {sorted(expected_columns)}"]
    left, right = rows_of(actual_columns, actual), rows_of(expected_columns, expected)
    out = []
    if len(left) != len(right):
        out.append(f"rows: {len(left)} against {len(right)}")
    for a, b in zip(left, right):
        if a != b or [kind(v) for v in a] != [kind(v) for v in b]:
            out.append(f"{a!r:.300} against {b!r:.300}")
            if len(out) > 3:
                break
    return out
