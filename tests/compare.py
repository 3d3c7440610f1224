"""Runs one registered query in Spark and its SQL in DuckDB, and compares all rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _cell(value):
    if value is None:
        return (0, "")
    if isinstance(value, float):
        return (1, "nan") if math.isnan(value) else (1, repr(value))
    return (1, str(value)) if not isinstance(value, int) else (1, repr(value))


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty when columns, number of rows and all values agree."""
    result = con.execute(sql)
    wanted_columns, wanted = _table([c[0] for c in result.description], result.fetchall())
    got_columns, got = _table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    problems = []
    if got_columns != wanted_columns:
        problems.append(f"columns {got_columns} != {wanted_columns}")
    if len(got) != len(wanted):
        problems.append(f"rows {len(got)} != {len(wanted)}")
    unequal = [(g, w) for g, w in zip(got, wanted) if g != w]
    if unequal:
        problems.append(f"{len(unequal)} rows differ, first: {unequal[:2]}")
    return problems
