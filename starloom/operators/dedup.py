"""One row per natural key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_natural_key(df: DataFrame, key: str) -> DataFrame:
    """Keep, per key, the row whose other columns are smallest in order.

    The survivor depends on the data alone. It is an aggregate, so copies of
    a hot key are merged before the shuffle and never meet in one task.
    """
    rest = [c for c in df.columns if c != key]
    if not rest:
        return df.distinct()
    return (
        df.groupBy(key)
        .agg(F.min(F.struct(*rest)).alias("survivor"))
        .select(*[F.col(c) if c == key else F.col(f"survivor.{c}") for c in df.columns])
    )


def duplicate_groups(df: DataFrame, *grain: str) -> DataFrame:
    """The value combinations of ``grain`` held by more than one row.

    Grouping by one struct makes Spark shuffle on the whole grain, after the
    map-side count, even where the input is already split by a part of it.
    One hot order therefore does not keep all its rows in one task.
    """
    return (
        df.groupBy(F.struct(*grain).alias("grain"))
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .select("grain.*", "n")
    )
