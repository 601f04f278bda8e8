"""The four dimensions.

Each builder selects its columns, keeps one row per natural key, cleans the
text afterwards (the key itself is never touched) and adds a surrogate key.
Keyword arguments are those of :func:`starloom.operators.add_surrogate_key`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.functions import calendar_parts, normalize_text
from starloom.operators import add_surrogate_key, dedup_natural_key
from starloom.sources.schemas import SOURCE_SCHEMAS


def _cleaned(raw: DataFrame, table: str, key: str, text: list[str]) -> DataFrame:
    members = dedup_natural_key(raw.select(*SOURCE_SCHEMAS[table].names), key)
    return members.withColumns({c: normalize_text(c) for c in text})


def build_dim_customers(customers: DataFrame, **keying) -> DataFrame:
    members = _cleaned(customers, "customers", "customer_id", ["customer_city", "customer_state"])
    keyed = add_surrogate_key(members, "customer_id", "CustomerKey", **keying)
    return keyed.select("CustomerKey", *members.columns)


def build_dim_products(products: DataFrame, **keying) -> DataFrame:
    members = _cleaned(products, "products", "product_id", ["product_category_name"])
    return add_surrogate_key(members, "product_id", "ProductKey", **keying)


def build_dim_sellers(sellers: DataFrame, **keying) -> DataFrame:
    members = _cleaned(sellers, "sellers", "seller_id", ["seller_city", "seller_state"])
    return add_surrogate_key(members, "seller_id", "SellerKey", **keying)


def sold_dates(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Distinct purchase dates of the orders that hold at least one item.

    These are the dates in the fact, found without building it: only the order
    ids of the items are read, and they are merged before they are shuffled.
    """
    sold = items.select("order_id").distinct()
    return (
        orders.select("order_id", F.to_date("order_purchase_ts").alias("Date"))
        .join(sold, "order_id", "left_semi")
        .select("Date")
        .distinct()
    )


def build_dim_date(dates: DataFrame, keep_null_member: bool = True, **keying) -> DataFrame:
    """Calendar of the given distinct dates; days without a sale are absent.

    An unparsed purchase time makes a member whose date is NULL. It takes the
    last key, so dropping it moves no other.
    """
    if not keep_null_member:
        dates = dates.where(F.col("Date").isNotNull())
    members = dates.select("Date", *calendar_parts("Date"))
    return add_surrogate_key(members, "Date", "DateKey", **keying)
