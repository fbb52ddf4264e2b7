"""Compare a Spark result with DuckDB's, ignoring row order."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, bool):
        return value
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, datetime):
        return value.date() if value.time() == datetime.min.time() else value
    if isinstance(value, date):
        return value
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        [tuple(_cell(row[i]) for i in order) for row in rows],
        key=lambda t: tuple((v is None, str(v)) for v in t),
    )


def spark_rows(df):
    return sorted(df.columns), _rows(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    return sorted(names), _rows(names, found.fetchall())


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "boolean": "BOOLEAN",
}


def types_of(df, con, sql):
    """Column types of both sides, in DuckDB's names."""
    ours = {name: KINDS.get(kind, kind) for name, kind in df.dtypes}
    theirs = {c[0]: str(c[1]) for c in con.execute(f"DESCRIBE {sql}").fetchall()}
    return ours, theirs
