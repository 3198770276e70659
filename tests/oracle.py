"""Compare registered queries with their SQL twins on the given tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        file = Path(sf_dir) / f"{name}.parquet"
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{file}'")
    return connection


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_cell(row[i]) for i in order) for row in rows], key=repr)


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


SPARK_TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "TINYINT": "tinyint",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
}


def differences(df, connection, sql):
    """Empty text if names, types, row count and values agree."""
    expected = connection.sql(sql)
    types = [SPARK_TYPES.get(str(t), str(t)) for t in expected.types]
    theirs = sorted(zip(expected.columns, types))
    if sorted(df.dtypes) != theirs:
        return f"schema {sorted(df.dtypes)} != {theirs}"
    mine = comparable(df.columns, df.collect())
    theirs = comparable(expected.columns, expected.fetchall())
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else ""
