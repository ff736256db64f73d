"""Run a registered query in Spark and its SQL in DuckDB and compare the two results as bags."""

from __future__ import annotations

import glob
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if value != value else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return value


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


def duck_result(con, sql):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    return columns, types, cursor.fetchall()


def difference(df, con, sql) -> str | None:
    """None if equal, otherwise a short description of the first difference."""
    columns, types, expected_rows = duck_result(con, sql)
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    rows = df.collect()
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for name, spark_type in df.dtypes:
        if kinds.get(spark_type) != types[name] and not (rows and types[name] == '"NULL"'):
            return f"type of {name}: {spark_type} vs {types[name]}"
    actual, expected = _bag(df.columns, rows), _bag(columns, expected_rows)
    if len(actual) != len(expected):
        return f"{len(actual)} rows vs {len(expected)}"
    for a, e in zip(actual, expected):
        if a != e:
            return f"{sorted(columns)}: {a} vs {e}"
    return None
