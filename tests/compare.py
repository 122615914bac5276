"""Row-for-row comparison of a Spark result with DuckDB's, whatever the order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        path = f"{folder}/{table}.parquet"
        if os.path.exists(path):
            connection.execute(
                f"create view {table} as select * from read_parquet('{path}')"
            )
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shuffled = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(shuffled, key=repr)


def differences(spark_df, connection, sql: str) -> list[str]:
    """What differs, in words; empty when names, types and rows agree."""
    ours_names, ours = _sorted(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    relation = connection.execute(sql)
    names = [d[0] for d in relation.description]
    theirs_names, theirs = _sorted(names, relation.fetchall())
    found = []
    if ours_names != theirs_names:
        return [f"columns {ours_names} against {theirs_names}"]
    if len(ours) != len(theirs):
        found.append(f"{len(ours)} rows against {len(theirs)}")
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if wrong:
        found.append(f"{len(wrong)} rows differ, first {wrong[0]}")
    kinds = [
        (a, type(x).__name__, type(y).__name__)
        for a, x, y in zip(ours_names, ours[0] if ours else (), theirs[0] if theirs else ())
        if x is not None and y is not None and type(x) is not type(y)
    ]
    if kinds:
        found.append(f"value types {kinds}")
    return found
