"""Key lookups and referential checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_key(df: DataFrame, dim: DataFrame, natural: str, surrogate: str) -> DataFrame:
    """Left-join a dimension's surrogate key on the natural key.

    Plain equality: a NULL natural key never matches and keeps its row. No
    broadcast hint is given. The dimensions are written tables, so Spark knows
    their size and broadcasts those below its threshold; beyond it the join
    shuffles and AQE splits hot keys on the fact side.
    """
    return df.join(dim.select(natural, surrogate), on=natural, how="left")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """One row: child keys without a parent, and the child rows they hold.

    NULL keys are not orphans. Both sides have one row per key before they
    meet, so neither a hot child key nor a much repeated parent piles up.
    """
    keys = child.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("k")).agg(F.count("*").alias("n"))
    known = parent.select(F.col(parent_key).alias("k")).distinct()
    return keys.join(known, "k", "left_anti").agg(
        F.count("*").alias("orphan_keys"),
        F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("orphan_rows"),
    )
