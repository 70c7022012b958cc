"""Side-by-side comparison of a Spark query and its SQL, independent of row and column order."""

from __future__ import annotations

from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    if value is None or value != value:
        return None
    if isinstance(value, float) and value == int(value) and abs(value) < 1e15:
        return int(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(normal(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(table, key=repr)


def difference(spark_df, con, sql: str) -> str | None:
    """None when both give the same columns and rows, else a short description."""
    columns, ours = rows_of(spark_df.columns, spark_df.collect())
    found = con.execute(sql)
    sql_columns, theirs = rows_of([d[0] for d in found.description], found.fetchall())
    if columns != sql_columns:
        return f"columns {columns} against {sql_columns}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(bad)} of {len(ours)} rows differ, first {bad[0]}" if bad else None
