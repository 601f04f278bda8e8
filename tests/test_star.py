import datetime as dt

import pytest
from pyspark.sql import functions as F

from starloom.functions import cast_measures, parse_purchase_timestamps
from starloom.operators import dedup_natural_key, duplicate_groups, lookup_key, orphans
from starloom.plans import build_fact_base, build_star
from starloom.plans.fact import FACT_COLUMNS


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)


def test_dimension_columns_and_types(spark, sources):
    star = build_star(sources)
    assert star.dim_customers.columns == [
        "CustomerKey", "customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city",
        "customer_state",
    ]
    assert star.dim_products.columns[0] == "product_id" and star.dim_products.columns[-1] == "ProductKey"
    assert star.dim_sellers.columns == [
        "seller_id", "seller_zip_code_prefix", "seller_city", "seller_state", "SellerKey",
    ]
    assert star.dim_date.dtypes == [
        ("Date", "date"), ("Year", "int"), ("Month", "int"), ("Day", "int"), ("Weekday", "int"), ("Quarter", "int"),
        ("DateKey", "bigint"),
    ]
    assert star.fact_order_items.dtypes == [
        ("order_id", "string"), ("order_item_id", "int"), ("price", "double"), ("order_status", "string"),
        ("freight_value", "double"), ("CustomerKey", "bigint"), ("ProductKey", "bigint"), ("SellerKey", "bigint"),
        ("DateKey", "bigint"),
    ]


def test_survivor_is_smallest_and_cleaned_afterwards(spark, sources):
    star = build_star(sources)
    assert rows(star.dim_customers) == [
        (1, "c1", "u1", "01235", "SANTOS", "SP"),
        (2, "c2", "u3", "99999", "RIO  DE JANEIRO", "RJ"),
    ]


def test_fact_of_the_hand_made_tables(spark, sources):
    fact = build_star(sources).fact_order_items
    # Dates: 2017-02-26 is 1, 2017-08-11 is 2, the NULL member 3; o6 has no item, o7 no order.
    assert rows(fact) == sorted(
        [
            ("o1", 1, 10.5, "delivered", 1.0, 1, 1, 1, 2),
            ("o1", 2, 20.0, "delivered", 2.0, 1, 2, 2, 2),
            ("o2", 1, 30.25, "shipped", 3.0, 1, 1, 1, 1),
            ("o3", 1, 40.0, "delivered", 4.0, None, None, 1, 2),
            ("o4", 1, 50.0, "canceled", 5.0, 2, 1, None, None),
            ("o5", 1, 60.0, "created", 6.0, 2, 1, None, None),
            ("o5", 1, 60.0, "created", 6.0, 2, 1, 1, None),
        ],
        key=repr,
    )


def test_dates_are_those_of_orders_with_items(spark, sources):
    star = build_star(sources)
    assert rows(star.dim_date, "Date", "DateKey") == sorted(
        [(dt.date(2017, 2, 26), 1), (dt.date(2017, 8, 11), 2), (None, 3)], key=repr
    )
    known = build_star(sources, keep_null_date=False)
    assert rows(known.dim_date, "DateKey") == [(1,), (2,)]
    assert rows(known.fact_order_items) == rows(star.fact_order_items)


def test_early_lookups_equal_lookups_after_the_join(spark, sources):
    """Looking keys up before the item-order join is a rewrite, not a change."""
    star = build_star(sources)
    late = build_fact_base(cast_measures(sources["order_items"]), parse_purchase_timestamps(sources["orders"]))
    late = late.withColumn("Date", F.to_date("order_purchase_ts"))
    for dim, natural, key in (
        (star.dim_customers, "customer_id", "CustomerKey"),
        (star.dim_products, "product_id", "ProductKey"),
        (star.dim_sellers, "seller_id", "SellerKey"),
        (star.dim_date, "Date", "DateKey"),
    ):
        late = lookup_key(late, dim, natural, key)
    assert rows(late.select(*FACT_COLUMNS)) == rows(star.fact_order_items)


def test_repeated_order_rows_fan_out_to_items(spark, sources):
    orders = sources["orders"]
    star = build_star({**sources, "orders": orders.unionAll(orders.where("order_id = 'o1'"))})
    assert star.fact_order_items.where("order_id = 'o1'").count() == 4
    assert star.quality_checks.first().duplicates == 3


def test_a_dimension_with_a_repeated_key_multiplies_rows(spark):
    fact = spark.createDataFrame([("a",), ("b",)], "id string")
    dim = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "id string, k int")
    assert lookup_key(fact, dim, "id", "k").count() == 3
    assert rows(duplicate_groups(dim, "id")) == [("a", 2)]


def test_layouts_and_shuffle_widths_agree_on_the_join(spark, conf, sources):
    dense = build_star(sources).fact_order_items
    packed = build_star(sources, layout="packed", buckets=7).fact_order_items
    plain = ("order_id", "order_item_id", "price")
    assert rows(packed, *plain) == rows(dense, *plain)
    for key in ("CustomerKey", "ProductKey", "SellerKey", "DateKey"):
        assert packed.where(F.col(key).isNull()).count() == dense.where(F.col(key).isNull()).count()
    conf(spark__sql__shuffle__partitions="11")
    assert rows(build_star(sources).fact_order_items) == rows(dense)


def test_bad_prices(spark, sources):
    items = sources["order_items"].withColumn("price", F.when(F.col("order_id") == "o1", "abc").otherwise(F.col("price")))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        build_star({**sources, "order_items": items}).fact_order_items.collect()
    kept = build_star({**sources, "order_items": items}, on_error="null").fact_order_items
    assert kept.where("price IS NULL").count() == 2 and kept.count() == 7


def test_dedup_orders_nulls_first_and_keeps_the_null_key(spark):
    df = spark.createDataFrame(
        [("a", "x", 2), ("a", None, 9), ("a", "x", 1), (None, "n", 1), (None, "m", 2)], "k string, s string, n int"
    )
    assert rows(dedup_natural_key(df, "k")) == sorted([("a", None, 9), (None, "m", 2)], key=repr)
    assert rows(dedup_natural_key(df.select("n", "k"), "k")) == sorted([(1, "a"), (1, None)], key=repr)
    assert rows(dedup_natural_key(df.select("k"), "k")) == sorted([("a",), (None,)], key=repr)


def test_join_column_appears_once_and_first(spark):
    items = spark.createDataFrame([(1, "o1")], "order_item_id int, order_id string")
    orders = spark.createDataFrame([("new", "o1")], "order_status string, order_id string")
    assert items.join(orders, "order_id").columns == ["order_id", "order_item_id", "order_status"]


def test_orphans_count_keys_and_rows_but_not_nulls(spark):
    child = spark.createDataFrame([("a",), ("x",), ("x",), ("y",), (None,)], "k string")
    parent = spark.createDataFrame([("a",), (None,)], "id string")
    assert rows(orphans(child, parent, "k", "id")) == [(2, 3)]
    assert rows(orphans(child.where("k = 'a'"), parent, "k", "id")) == [(0, 0)]
