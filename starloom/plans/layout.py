"""The fact laid out by its grain, so that checks and rollups by order need no exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tells the parts of a hot order apart; an order that lies in one bucket has WHOLE.
PART = "order_part"
WHOLE = -1
# Hot orders that are split at most; each takes more than 1 / (4 * buckets) of the rows.
MOST_HOT = 1024
# An order of fewer rows is no burden to any task.
LEAST_HOT = 10_000


def hot_orders(order_ids: DataFrame, buckets: int) -> list:
    """The ids of orders too large for one bucket, from a Misra-Gries summary of the items."""
    found = order_ids.agg(F.expr(f"approx_top_k(order_id, {MOST_HOT}, {8 * MOST_HOT})").alias("top"), F.count("*").alias("n")).first()
    return [item["item"] for item in found.top or [] if item["count"] > max(LEAST_HOT, found.n // (4 * buckets))]


def freeze_by_grain(fact: DataFrame, order_ids: DataFrame, path: str, buckets: int) -> DataFrame:
    """Write the fact in buckets by order, sorted by its grain, and return the table with ``order_part``.

    The rows of an order lie in one bucket, but for hot orders, whose items are dealt over all
    buckets by ``order_part``. Spark knows the layout: what groups by order_id and order_part,
    and more, needs no exchange. One file a bucket is written. The table is external and
    named in the session's catalog; :func:`drop_laid_out` forgets it.
    """
    hot = hot_orders(order_ids, buckets)
    dealt = F.pmod(F.hash("order_item_id"), F.lit(buckets))
    part = F.when(F.col("order_id").isin(hot), dealt).otherwise(F.lit(WHOLE)) if hot else F.lit(WHOLE)
    name = f"starloom_{uuid.uuid4().hex}"
    # The bucket of a row is its partition, so each task writes one bucket.
    rows = fact.withColumn(PART, part.cast("int")).repartition(buckets, "order_id", PART)
    keys = ("order_id", PART)
    rows.write.bucketBy(buckets, *keys).sortBy(*keys, "order_item_id").option("path", path).format("parquet").saveAsTable(name)
    return fact.sparkSession.table(name)


def drop_laid_out(spark: SparkSession, path: str) -> None:
    """Forget the tables of the session whose files lie below ``path``; the files stay."""
    for table in spark.catalog.listTables():
        if table.name.startswith("starloom_"):
            described = spark.sql(f"DESCRIBE TABLE EXTENDED {table.name}").where("col_name = 'Location'").first()
            if described and path in described.data_type:
                spark.sql(f"DROP TABLE IF EXISTS {table.name}")
