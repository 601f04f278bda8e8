"""The benchmark's Parquet tables seen as the five raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Given schemas spare a job per table to infer them.
BENCH_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def bench_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(BENCH_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def raw_tables(
    spark: SparkSession, sf_dir: str, dirty: bool = False, missing: bool = False
) -> dict[str, DataFrame]:
    """The raw tables, clean or with faults that rules on the data put in.

    The dirty set has padded lower-case text, repeated natural keys, purchase
    times in another format for urgent orders and none at all for low-priority
    partial ones. With ``missing`` a segment of customers is absent, for the
    queries that look for parents which are not there.
    """

    def table(name):
        return bench_table(spark, sf_dir, name)

    purchase = F.date_format("o_orderdate", "M/d/yyyy H:mm")
    if dirty:
        purchase = (
            F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
            .when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P"), F.lit(None))
            .otherwise(purchase)
        )
    orders = table("orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("order_status"),
        purchase.alias("order_purchase_timestamp"),
    )
    order_items = table("lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_tax").alias("freight_value"),
    )

    def padded(column):
        return F.concat(F.lit("  "), F.lower(column), F.lit(" ")) if dirty else F.col(column)

    nation = table("nation").select("n_nationkey", "n_name")
    customer = table("customer")
    supplier = table("supplier")
    part = table("part")
    if missing:
        customer = customer.where("c_mktsegment <> 'BUILDING'")
    if dirty:
        customer = customer.unionAll(customer.where("c_acctbal < 0").withColumn("c_name", F.concat("c_name", F.lit("/2"))))
        supplier = supplier.unionAll(supplier.where("s_acctbal < 0").withColumn("s_name", F.concat(F.lit("Acme "), "s_name")))
        part = part.withColumn("p_type", F.when(F.col("p_brand") != "Brand#1", F.col("p_type")))
        part = part.unionAll(part.where("p_size <= 5").withColumn("p_type", F.lit("aged")))
    customers = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_unique_id"),
        F.col("c_nationkey").cast("string").alias("customer_zip_code_prefix"),
        padded("c_mktsegment").alias("customer_city"),
        padded("n_name").alias("customer_state"),
    )
    sellers = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("seller_id"),
        F.col("s_nationkey").cast("string").alias("seller_zip_code_prefix"),
        padded("s_name").alias("seller_city"),
        padded("n_name").alias("seller_state"),
    )
    products = part.select(
        F.col("p_partkey").alias("product_id"),
        padded("p_type").alias("product_category_name"),
        F.length("p_name").alias("product_name_lenght"),
        F.length("p_brand").alias("product_description_lenght"),
        F.floor("p_retailprice").cast("int").alias("product_photos_qty"),
        F.col("p_size").alias("product_weight_g"),
        F.col("p_size").alias("product_length_cm"),
        F.length("p_name").alias("product_height_cm"),
        F.length("p_brand").alias("product_width_cm"),
    )
    return {
        "orders": orders,
        "order_items": order_items,
        "customers": customers,
        "products": products,
        "sellers": sellers,
    }
