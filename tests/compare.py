"""Run a registered query and its SQL check, and compare the rows."""

from __future__ import annotations

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents")


def open_tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _rows(table, columns):
    rows = zip(*[table.column(c).to_pylist() for c in columns], strict=True)
    return sorted((tuple(row) for row in rows), key=repr)


def difference(df, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs between the two results, or None."""
    ours = df.toArrow()
    theirs = connection.sql(sql).to_arrow_table()
    if sorted(ours.column_names) != sorted(theirs.column_names):
        return f"columns {ours.column_names} against {theirs.column_names}"
    columns = sorted(ours.column_names)
    types = [(c, str(ours.schema.field(c).type), str(theirs.schema.field(c).type)) for c in columns]
    unlike = [t for t in types if t[1].removeprefix("large_") != t[2].removeprefix("large_")]
    if unlike:
        return f"types {unlike}"
    mine, other = _rows(ours, columns), _rows(theirs, columns)
    if len(mine) != len(other):
        return f"{len(mine)} rows against {len(other)}"
    unequal = [(a, b) for a, b in zip(mine, other, strict=True) if a != b]
    return f"{len(unequal)} rows differ, first {unequal[0]}" if unequal else None
