"""Full refresh of warehouse tables over JDBC."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from starloom.plans.quality import quality_checks, quality_findings
from starloom.plans.star import STAR_TABLES

# Options of Spark's reader and writer that are no properties of a connection.
SPARK_OPTIONS = ("url", "dbtable", "truncate", "cascadetruncate", "numpartitions", "batchsize", "fetchsize", "isolationlevel")


def jdbc_options(connection: Mapping[str, str], table: str, schema: str | None = "dwh") -> dict[str, str]:
    """Reader and writer options for one table; ``connection`` holds url, driver, user, ...

    At most 16 connections write at once; ``numPartitions`` in the connection
    changes that.
    """
    if "url" not in connection:
        raise ValueError("a JDBC connection needs a url")
    return {"numPartitions": "16", **connection, "dbtable": _named(table, schema)}


def _named(table: str, schema: str | None) -> str:
    return f"{schema}.{table}" if schema else table


def publish_jdbc(
    tables: Mapping[str, DataFrame],
    connection: Mapping[str, str],
    schema: str | None = "dwh",
    gate: str = "warn",
    attempts: int = 3,
    findings: Mapping[str, int] | None = None,
) -> dict[str, int]:
    """Empty and refill the warehouse tables as one transaction; returns the rows of each.

    Each table is first loaded into a staging table of its own. Its partitions
    commit one by one, and a task whose executor dies between commit and report
    runs again, so the rows are counted after every load, and a staging table that
    came out different is loaded anew: nobody reads it. Then one transaction truncates all
    tables in one statement, restarts their identity columns, and fills them from
    staging, dimensions first: readers see the old star or the new one. Tables keep
    their definition. The staging tables are dropped, also after a failure. Pass
    written tables; ``findings`` of checks made already spare making them again.

    The statements are those of PostgreSQL.
    """
    quality_findings(quality_checks(tables["fact_order_items"]) if findings is None else findings, gate)
    spark, run = tables["fact_order_items"].sparkSession, uuid.uuid4().hex[:12]
    staged = {name: f"stage_{run}_{name}" for name in STAR_TABLES}
    try:
        loaded = {name: _load(tables[name], jdbc_options(connection, staged[name], schema), attempts) for name in STAR_TABLES}
        _run(spark, connection, refresh_statements({name: tables[name].columns for name in STAR_TABLES}, staged, schema))
    finally:
        _run(spark, connection, [f"DROP TABLE IF EXISTS {_named(table, schema)}" for table in staged.values()])
    return loaded


def refresh_statements(columns: Mapping[str, Sequence[str]], staged: Mapping[str, str], schema: str | None) -> list[str]:
    """One truncate of all tables, the fact first, and then an insert from staging for each, the fact last."""
    every = ", ".join(_named(name, schema) for name in reversed(list(columns)))
    out = [f"TRUNCATE TABLE {every} RESTART IDENTITY CASCADE"]
    for name, own in columns.items():
        listed = ", ".join('"' + c.replace('"', '""') + '"' for c in own)
        out.append(f"INSERT INTO {_named(name, schema)} ({listed}) SELECT {listed} FROM {_named(staged[name], schema)}")
    return out


def _load(df: DataFrame, options: Mapping[str, str], attempts: int) -> int:
    expected = df.count()
    for _ in range(attempts):
        df.write.format("jdbc").options(**options).mode("overwrite").save()
        found = _rows_in(df, options)
        if found == expected:
            return found
    raise RuntimeError(f"{options['dbtable']} holds {found} rows, not {expected}")


def _rows_in(df: DataFrame, options: Mapping[str, str]) -> int:
    # The database counts; one row comes back.
    counted = {**options, "dbtable": f"(SELECT count(*) AS n FROM {options['dbtable']}) counted"}
    return int(df.sparkSession.read.format("jdbc").options(**counted).load().first()[0])


def _connect(spark: SparkSession, connection: Mapping[str, str]):
    """A connection of the driver's JVM, by the driver class that Spark's own writer takes."""
    sql = spark._jvm.org.apache.spark.sql
    if "driver" in connection:
        sql.execution.datasources.jdbc.DriverRegistry.register(connection["driver"])
    properties = spark._jvm.java.util.Properties()
    for name, value in connection.items():
        if name.lower() not in (*SPARK_OPTIONS, "driver"):
            properties.setProperty(name, value)
    return spark._jvm.java.sql.DriverManager.getConnection(connection["url"], properties)


def _run(spark: SparkSession, connection: Mapping[str, str], statements: Sequence[str]) -> None:
    """All statements, or none, as one transaction."""
    link = _connect(spark, connection)
    try:
        link.setAutoCommit(False)
        try:
            for statement in statements:
                call = link.createStatement()
                call.execute(statement)
                call.close()
            link.commit()
        except Exception:
            link.rollback()
            raise
    finally:
        link.close()
