"""Compare a registered query with its SQL run by DuckDB."""

from __future__ import annotations

import math
import pathlib

import duckdb


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in pathlib.Path(directory).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


def difference(df, con, sql: str) -> str | None:
    """What differs in names, types or values, or None."""
    relation = con.sql(sql)
    want_types = dict(zip(relation.columns, map(str, relation.types)))
    got_types = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    if got_types != want_types:
        return f"types: spark {got_types}, sql {want_types}"
    names, got = rows_of(df.columns, df.collect())
    _, want = rows_of(relation.columns, relation.fetchall())
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        missing = [r for r in want if r not in set(got)][:3]
        return f"values in {names}: {len(got)} vs {len(want)} rows, spark only {extra}, sql only {missing}"
    if not got:
        return "no rows"
    return None
