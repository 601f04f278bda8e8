"""Cutting lineage with a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def freeze(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to ``path`` once and return the written table.

    A cached table is computed again when its executor is lost; a written one
    is not. It is columnar, so later reads prune columns, and its file sizes
    give the optimizer a true size for choosing broadcasts.
    """
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
