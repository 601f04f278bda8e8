"""The order-item fact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.operators import lookup_key

# The published column orders.
BASE_COLUMNS = (
    "order_id",
    "order_item_id",
    "product_id",
    "customer_id",
    "price",
    "seller_id",
    "order_status",
    "freight_value",
    "order_purchase_ts",
)
FACT_COLUMNS = (
    "order_id",
    "order_item_id",
    "price",
    "order_status",
    "freight_value",
    "CustomerKey",
    "ProductKey",
    "SellerKey",
    "DateKey",
)


def build_fact_base(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Items with their order's columns; an item without an order is dropped."""
    return items.join(orders, "order_id").select(*BASE_COLUMNS)


def build_fact(
    items: DataFrame,
    orders: DataFrame,
    dim_customers: DataFrame | None = None,
    dim_products: DataFrame | None = None,
    dim_sellers: DataFrame | None = None,
    dim_date: DataFrame | None = None,
) -> DataFrame:
    """The fact with a foreign key for each dimension given; unknown members give NULL keys.

    Customer and date belong to the order, so they are looked up on the order
    rows, and product and seller on the item rows, before the two meet. Only
    narrow bigint keys cross the order_id shuffle, and item rows never shuffle
    by customer or date.
    """
    order_rows = orders.select(
        "order_id", "order_status", "customer_id", F.to_date("order_purchase_ts").alias("Date")
    )
    if dim_customers is not None:
        order_rows = lookup_key(order_rows, dim_customers, "customer_id", "CustomerKey")
    if dim_date is not None:
        order_rows = lookup_key(order_rows, dim_date, "Date", "DateKey")
    order_rows = order_rows.drop("customer_id", "Date")

    item_rows = items.select("order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value")
    if dim_sellers is not None:
        item_rows = lookup_key(item_rows, dim_sellers, "seller_id", "SellerKey")
    if dim_products is not None:
        item_rows = lookup_key(item_rows, dim_products, "product_id", "ProductKey")
    item_rows = item_rows.drop("product_id", "seller_id")

    fact = item_rows.join(order_rows, "order_id")
    return fact.select(*[c for c in FACT_COLUMNS if c in fact.columns])
