"""Compares a registered query with its SQL counterpart, value by value."""

from pathlib import Path

import duckdb
import pandas as pd

import __spark_entry__ as entry_point

QUERIES = entry_point.queries()
ORACLES = entry_point.oracle_sql()
# The training-data queries have tests of their own, and not all of them have SQL.
LIBRARY = [name for name, query in QUERIES.items() if query.__module__ == entry_point.__name__]

KINDS = {
    "INTEGER": "int",
    "BIGINT": "bigint",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
}


def connect(sf_dir) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        source = f"{file}/*.parquet" if file.is_dir() else str(file)
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{source}')")
    return con


def _sorted(rows, columns) -> list[tuple]:
    frame = pd.DataFrame(rows, columns=columns, dtype=object)
    frame = frame[sorted(columns)]
    frame = frame.where(frame.notna(), None)
    return sorted(map(tuple, frame.itertuples(index=False)), key=repr)


def assert_same(spark, con, name, sf_dir) -> None:
    ours = QUERIES[name](spark, str(sf_dir))
    theirs = con.sql(ORACLES[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert dict(ours.dtypes) == {
        column: KINDS[str(kind)] for column, kind in zip(theirs.columns, theirs.types)
    }
    rows = _sorted([tuple(row) for row in ours.collect()], ours.columns)
    assert rows
    assert rows == _sorted(theirs.fetchall(), theirs.columns)
