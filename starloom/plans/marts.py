"""Rollups over a star, one hop from the fact to a dimension.

Where a group is made of whole members, the fact is aggregated by surrogate
key before it meets the dimension, so a hot member is one row by then. Money
is summed as decimal: the result does not depend on the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.plans.layout import PART, WHOLE


def _exact_sum(column: str) -> Column:
    return F.sum(F.col(column).cast("decimal(18,2)"))


def _total(column: str) -> Column:
    return F.sum(column).cast("double").alias(column)


def sales_by_month(fact: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Items, distinct orders and revenue by year and month."""
    dated = fact.join(dim_date.select("DateKey", "Year", "Month"), "DateKey", "left")
    return _with_orders(dated, "Year", "Month").select("Year", "Month", "items", "orders", "revenue")


def product_performance(fact: DataFrame, dim_products: DataFrame) -> DataFrame:
    """Items, revenue and freight by product category."""
    per_product = fact.groupBy("ProductKey").agg(
        F.count("*").alias("items"), _exact_sum("price").alias("revenue"), _exact_sum("freight_value").alias("freight")
    )
    return (
        per_product.join(dim_products.select("ProductKey", "product_category_name"), "ProductKey", "left")
        .groupBy("product_category_name")
        .agg(F.sum("items").alias("items"), _total("revenue"), _total("freight"))
    )


def customer_behavior(fact: DataFrame, dim_customers: DataFrame) -> DataFrame:
    """Orders, items and revenue per customer."""
    return (
        _with_orders(fact, "CustomerKey")
        .join(dim_customers.select("CustomerKey", "customer_id"), "CustomerKey", "left")
        .select("customer_id", "orders", "items", "revenue")
    )


def status_mix(fact: DataFrame) -> DataFrame:
    """Items, orders and revenue by order status."""
    return _with_orders(fact, "order_status").select("order_status", "items", "orders", "revenue")


def _with_orders(fact: DataFrame, *by: str) -> DataFrame:
    """Items, distinct orders and revenue, first per order, then per group.

    Two steps, so that a group with a third of the rows spreads by order; and
    one struct, so that Spark shuffles on all of it, as in the quality checks. A
    fact that lies by order is not shuffled for the first step; the orders that are
    dealt over several buckets there are few, and counted by their ids.
    """
    if PART in fact.columns:
        per_part = fact.groupBy(*by, "order_id", PART).agg(F.count("*").alias("items"), _exact_sum("price").alias("revenue"))
        whole = F.col(PART) == WHOLE
        dealt = F.size(F.collect_set(F.when(~whole, F.col("order_id"))))
        return per_part.groupBy(*by).agg(
            F.sum("items").alias("items"), (F.count_if(whole) + dealt).alias("orders"), _total("revenue")
        )
    per_order = fact.groupBy(F.struct(*by, "order_id").alias("g")).agg(
        F.count("*").alias("items"), _exact_sum("price").alias("revenue")
    )
    return per_order.groupBy(*[F.col(f"g.{c}").alias(c) for c in by]).agg(
        F.sum("items").alias("items"), F.count("g.order_id").alias("orders"), _total("revenue")
    )
