"""Reading the raw tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from starloom.sources.schemas import SOURCE_SCHEMAS


def scan_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | None = None,
    infer_schema: bool = False,
    whole_rows: bool = False,
) -> DataFrame:
    """Scan CSV with a header row, binding ``schema`` to the header by name.

    Columns of the file that the schema does not name are skipped. A row that
    does not fit the schema fails the job. By default Spark parses only the
    columns a query uses, and bad values elsewhere go unseen; with ``whole_rows``
    every query fails on them. ``infer_schema`` lets Spark choose the types
    instead, which costs one more pass over the files.
    """
    reader = spark.read.option("header", True).option("escape", '"')
    if infer_schema:
        return reader.option("inferSchema", True).csv(path)
    header = reader.csv(path).columns
    if schema is None:
        schema = StructType([StructField(name, StringType()) for name in header])
    missing = sorted(set(schema.names) - set(header))
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    typed = StructType([schema[name] if name in schema.names else StructField(name, StringType()) for name in header])
    # The header of every file is held against the schema, not just the first.
    rows = reader.schema(typed).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    if whole_rows:
        # True for every row, but the optimizer cannot know, so no column is pruned from the parser.
        rows = rows.where(F.hash(*[f"`{c}`" for c in rows.columns]) >= F.lit(-(1 << 31)))
    return rows.select(*schema.names)


def scan_rejects(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(file, rows, rejects) for each CSV file: its rows, and those with a value that does not fit ``schema``.

    The values are read as text and tried one by one, so it fails on no row; use it
    to find what made :func:`scan_csv` fail. NULL and empty values fit any type.
    """
    reader = spark.read.option("header", True).option("escape", '"')
    header = reader.csv(path).columns
    text = reader.schema(StructType([StructField(name, StringType()) for name in header])).csv(path)
    unfit = F.lit(False)
    for field in schema:
        if field.name in header:
            unfit = unfit | (F.col(field.name).isNotNull() & F.col(field.name).try_cast(field.dataType).isNull())
    return text.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count("*").alias("rows"), F.count_if(unfit).alias("rejects")
    )


def load_sources(
    spark: SparkSession,
    base: str,
    fmt: str = "csv",
    pattern: str = "{table}.{fmt}",
    infer_schema: bool = False,
) -> dict[str, DataFrame]:
    """Load the five raw tables; the first that cannot be read raises.

    Rows of CSV are checked as a whole, also in columns that no query reads.
    """
    loaded = {}
    for table, schema in SOURCE_SCHEMAS.items():
        path = f"{base.rstrip('/')}/{pattern.format(table=table, fmt=fmt)}"
        if fmt == "csv":
            loaded[table] = scan_csv(spark, path, schema, infer_schema, whole_rows=True)
        elif fmt == "parquet":
            loaded[table] = spark.read.parquet(path).select(*schema.names)
        else:
            raise ValueError(f"fmt must be 'csv' or 'parquet', not {fmt!r}")
    return loaded


def load_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table, in one job: one (name, n) row for each entry."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionAll, counts)
