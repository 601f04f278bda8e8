"""Plans and skew: what must hold whatever the size of the data."""

import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from starloom.operators import dedup_natural_key, orphans
from starloom.plans import build_star, marts, quality_checks
from starloom.plans.dimensions import sold_dates
from starloom.functions import parse_purchase_timestamps
from starloom.sources.bench_tables import raw_tables
from starloom.workload import QUERIES


SPLIT_JOIN = r"(SortMergeJoin|ShuffledHashJoin)\(skew=true\)"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    text = plan_of(df)
    return text.split("== Initial Plan ==")[0]


@pytest.fixture
def no_broadcast(conf):
    """Tiny thresholds, so that small tables take the plans of large ones."""
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="16KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="8KB",
        spark__sql__adaptive__coalescePartitions__enabled="false",
        spark__sql__shuffle__partitions="8",
    )


@pytest.fixture
def hot(spark):
    """A third of the items in one order, a third of one product, a third of the orders of one customer."""
    raw = raw_tables(spark, "/root/testdata/sf0.01")
    items, orders = raw["order_items"], raw["orders"]
    third = F.pmod(F.xxhash64("product_id", "seller_id"), F.lit(3)) == 0
    other = F.pmod(F.xxhash64("seller_id", "product_id"), F.lit(3)) == 1
    raw["order_items"] = (
        items.withColumn("hot", other)
        .withColumn("order_id", F.when(third, F.lit(7)).otherwise(F.col("order_id")).cast("bigint"))
        .withColumn("product_id", F.when(F.col("hot"), F.lit(7)).otherwise(F.col("product_id")).cast("bigint"))
        .drop("hot")
        .repartition(12)
    )
    raw["orders"] = orders.withColumn(
        "customer_id", F.when(F.pmod("order_id", F.lit(3)) == 0, F.lit(7)).otherwise(F.col("customer_id")).cast("bigint")
    ).repartition(12)
    return raw


@pytest.mark.parametrize("hash_below", ["0", "64MB"])
def test_hot_keys_are_split_in_every_shuffled_join(spark, conf, no_broadcast, hot, hash_below):
    conf(spark__sql__adaptive__maxShuffledHashJoinLocalMapThreshold=hash_below)
    star = build_star(hot)
    plan = final_plan(star.fact_order_items)
    assert "Broadcast" not in plan
    for key in ("order_id", "product_id", "customer_id"):
        assert re.search(rf"{SPLIT_JOIN} \[{key}#", plan), plan


def test_hot_order_is_split_below_the_checks_and_rollups(spark, no_broadcast, hot):
    star = build_star(hot)
    for df in (quality_checks(star.fact_order_items), marts.status_mix(star.fact_order_items)):
        assert re.search(SPLIT_JOIN, final_plan(df))


def test_hot_data_gives_the_same_fact_as_broadcast_joins(spark, conf, no_broadcast, hot):
    columns = ("order_id", "order_item_id", "CustomerKey", "ProductKey", "SellerKey", "DateKey")
    digest = F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.count("*")
    skewed = build_star(hot).fact_order_items.agg(*digest).first()
    conf(spark__sql__autoBroadcastJoinThreshold="100MB", spark__sql__adaptive__skewJoin__enabled="false")
    assert build_star(hot).fact_order_items.agg(*digest).first() == skewed


def test_copies_of_a_hot_key_are_merged_before_the_shuffle(spark):
    df = spark.range(1000).select(F.pmod("id", F.lit(1)).alias("k"), F.col("id").cast("string").alias("v"))
    for merged in (dedup_natural_key(df, "k"), orphans(df, spark.range(9), "k", "id")):
        plan = plan_of(merged)
        assert re.search(r"Exchange hashpartitioning\(k#.*\n.*partial_", plan), plan


def test_scans_read_only_what_is_used(spark):
    raw = raw_tables(spark, SMALL)
    plan = plan_of(sold_dates(raw["order_items"], parse_purchase_timestamps(raw["orders"])))
    assert "ReadSchema: struct<l_orderkey:bigint>" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan
    assert "IsNotNull(l_orderkey)" in plan
    star = build_star(raw)
    plan = plan_of(star.fact_order_items)
    assert "customer_city" not in plan and "product_category_name" not in plan
    assert "l_quantity" not in plan


def test_items_cross_one_shuffle_when_dimensions_are_small(spark, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="60KB", spark__sql__shuffle__partitions="4")
    star = build_star(raw_tables(spark, "/root/testdata/sf0.01"))
    plan = plan_of(star.fact_order_items)
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("BroadcastHashJoin") == 4, plan


def test_dense_keys_use_no_single_partition_window(spark):
    plans = [plan_of(QUERIES[name](spark, SMALL)) for name in ("surrogate_key_dense", "dim_customers", "dim_date")]
    assert not any("Window" in p or "SinglePartition" in p for p in plans)


def test_rollups_build_only_the_dimension_they_use(spark):
    used = {
        "mart_status_mix": None,
        "mart_sales_by_month": "DateKey",
        "mart_product_performance": "ProductKey",
        "mart_customer_behavior": "CustomerKey",
    }
    for name, own in used.items():
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        found = {key for key in ("CustomerKey", "ProductKey", "SellerKey", "DateKey") if key in plan}
        assert found == ({own} if own else set()), name


def test_checks_and_rollups_of_a_laid_out_fact_exchange_sums_alone(spark, conf, no_broadcast, hot):
    """Rows stay where they lie; only partial sums move. The hot order is dealt over all buckets."""
    star, plain = build_star(hot), build_star(hot)
    laid = star.lay_out_fact(8)
    assert star.lay_out_fact() is laid and star.fact_order_items.columns == plain.fact_order_items.columns
    sizes = sorted(r["count"] for r in laid.groupBy(F.spark_partition_id()).count().collect())
    # The order has a third of the rows, and seven item numbers to deal them by.
    assert len(sizes) == 8 and sizes[-1] < sum(sizes) / 4, sizes
    assert laid.where("order_part >= 0").select("order_id").distinct().collect() == [(7,)]
    for name in ("status_mix", "customer_behavior", "sales_by_month"):
        if name == "sales_by_month":
            # The calendar goes to the fact, not the fact to the calendar.
            conf(spark__sql__autoBroadcastJoinThreshold="10MB")
        plan = plan_of(star.rollup(name))
        # Above the scan of the fact comes a whole aggregate by order before anything moves.
        assert not re.search(r"Exchange hashpartitioning\([^)]*order_id", plan), plan
        assert sorted(map(repr, star.rollup(name).collect())) == sorted(map(repr, plain.rollup(name).collect()))
    checks = plan_of(star.quality_checks)
    assert "hashpartitioning" not in checks and checks.count("Exchange SinglePartition") > 0, checks
    assert star.quality_checks.collect() == plain.quality_checks.collect()
    scratch = star.scratch
    star.drop()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("starloom_")]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{scratch}/fact_by_grain")


def test_an_ordinary_fact_lies_whole(spark, sources):
    star = build_star(sources)
    laid = star.lay_out_fact(3)
    assert {r.order_part for r in laid.collect()} == {-1}
    assert star.quality_checks.collect() == build_star(sources).quality_checks.collect()
    star.drop()
