"""One query per operator: (spark, folder of benchmark tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions import (
    cast_measures,
    normalize_text,
    parse_check,
    parse_purchase_timestamps,
    zip_prefix,
)
from starloom.operators import add_surrogate_key, dedup_natural_key, duplicate_groups, orphans
from starloom.plans import (
    build_dim_customers,
    build_dim_date,
    build_dim_products,
    build_dim_sellers,
    build_fact_base,
    build_star,
)
from starloom.plans.dimensions import sold_dates
from starloom.run import run_star
from starloom.session import new_scratch, tune, widen_shuffle
from starloom.sinks import export_csv, export_text, publish_parquet, read_published, verify_published
from starloom.sources import SOURCE_SCHEMAS, load_counts, scan_csv, scan_rejects
from starloom.sources.bench_tables import bench_table, raw_tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


@lru_cache
def _widened(spark: SparkSession, sf_dir: str) -> int:
    """Fit the shuffle width to the large tables, once per session and folder."""
    return widen_shuffle(spark, {name: bench_table(spark, sf_dir, name) for name in ("lineitem", "orders", "documents")})


def query(name: str) -> Callable[[Query], Query]:
    """Register a function under ``name``, to be run in a tuned session."""

    def register(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            _widened(spark, sf_dir)
            return function(spark, sf_dir)

        QUERIES[name] = run
        return function

    return register


def _star(spark, sf_dir, dirty=True, missing=False, **options):
    return build_star(raw_tables(spark, sf_dir, dirty, missing), **options)


def _row(spark: SparkSession, **values) -> DataFrame:
    """One row of what a run reported."""
    return spark.range(1).select(*[F.lit(value).cast("bigint").alias(name) for name, value in values.items()])


def _checked(spark, sf_dir, **options) -> DataFrame:
    """The findings of a run: NULLs are counted while the fact is written."""
    star = run_star(spark, raw_tables(spark, sf_dir, dirty=True, missing=True), **options)
    return _row(spark, **star.report.findings)


def _plain_time(df: DataFrame, column: str) -> DataFrame:
    """Timestamps without a zone, as the check's engine has them."""
    return df.withColumn(column, F.col(column).cast("timestamp_ntz"))


# --- sources ---------------------------------------------------------------


@query("load_counts")
def load_counts_of_sources(spark, sf_dir):
    return load_counts(raw_tables(spark, sf_dir))


@query("load_counts_tables")
def load_counts_of_tables(spark, sf_dir):
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    return load_counts({name: bench_table(spark, sf_dir, name) for name in names})


@query("scan_csv")
def scan_csv_items(spark, sf_dir):
    path = new_scratch(spark)
    export_csv(raw_tables(spark, sf_dir)["order_items"], path)
    return cast_measures(scan_csv(spark, path, SOURCE_SCHEMAS["order_items"]))


@query("scan_csv_inferred")
def scan_csv_inferred(spark, sf_dir):
    path = new_scratch(spark)
    export_csv(raw_tables(spark, sf_dir)["sellers"], path)
    return scan_csv(spark, path, infer_schema=True)


@query("scan_rejects")
def scan_rejects_of_items(spark, sf_dir):
    """Items of a CSV file whose line numbers 3 are no numbers: rows and rejects over all files."""
    path = new_scratch(spark)
    items = raw_tables(spark, sf_dir)["order_items"]
    number = F.col("order_item_id").cast("string")
    export_csv(items.withColumn("order_item_id", F.when(number == "3", "three").otherwise(number)), path)
    found = scan_rejects(spark, path, SOURCE_SCHEMAS["order_items"])
    return found.agg(F.sum("rows").alias("n_rows"), F.sum("rejects").alias("n_rejects"))


# --- cleaning --------------------------------------------------------------


def _text_items(spark, sf_dir, price):
    return bench_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        price.alias("price"),
        F.col("l_tax").cast("string").alias("freight_value"),
    )


@query("cast_measures")
def cast_measures_strict(spark, sf_dir):
    return cast_measures(_text_items(spark, sf_dir, F.col("l_extendedprice").cast("string")))


@query("cast_measures_null")
def cast_measures_null(spark, sf_dir):
    price = F.when(F.col("l_linenumber") == 3, "abc").otherwise(F.col("l_extendedprice").cast("string"))
    return cast_measures(_text_items(spark, sf_dir, price), on_error="null")


@query("parse_purchase_ts")
def parse_purchase_ts(spark, sf_dir):
    orders = parse_purchase_timestamps(raw_tables(spark, sf_dir, dirty=True)["orders"])
    return _plain_time(orders.select("order_id", "order_purchase_ts"), "order_purchase_ts")


@query("parse_check")
def parse_check_of_orders(spark, sf_dir):
    orders = parse_purchase_timestamps(raw_tables(spark, sf_dir, dirty=True)["orders"])
    return parse_check(orders, "order_purchase_timestamp", "order_purchase_ts")


@query("normalize_text")
def normalize_text_of_customers(spark, sf_dir):
    customers = raw_tables(spark, sf_dir, dirty=True)["customers"]
    return customers.select(
        "customer_id",
        normalize_text("customer_city").alias("customer_city"),
        normalize_text("customer_state").alias("customer_state"),
    )


@query("zip_prefix_styles")
def zip_prefix_styles(spark, sf_dir):
    styles = [zip_prefix("customer_zip_code_prefix", style).alias(f"zip_{style}") for style in ("text", "padded", "int")]
    return raw_tables(spark, sf_dir)["customers"].select("customer_id", *styles)


# --- keys and deduplication ------------------------------------------------


@query("dedup_natural_key")
def dedup_key(spark, sf_dir):
    customer = bench_table(spark, sf_dir, "customer")
    return dedup_natural_key(customer.select("c_nationkey", "c_mktsegment", "c_name"), "c_nationkey")


@query("distinct_purchase_ts")
def distinct_purchase_ts(spark, sf_dir):
    orders = parse_purchase_timestamps(raw_tables(spark, sf_dir, dirty=True)["orders"])
    return _plain_time(orders.select("order_purchase_ts").distinct(), "order_purchase_ts")


@query("surrogate_key_dense")
def surrogate_key_dense(spark, sf_dir):
    return add_surrogate_key(bench_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "OrderKey")


@query("surrogate_key_string")
def surrogate_key_string(spark, sf_dir):
    texts = bench_table(spark, sf_dir, "documents").select("text").distinct()
    return add_surrogate_key(texts, "text", "TextKey", long_text=True)


@query("surrogate_key_hex")
def surrogate_key_hex(spark, sf_dir):
    ids = bench_table(spark, sf_dir, "orders").select(F.md5(F.col("o_orderkey").cast("string")).alias("order_id"))
    return add_surrogate_key(ids, "order_id", "OrderKey")


@query("surrogate_key_packed")
def surrogate_key_packed(spark, sf_dir):
    orders = bench_table(spark, sf_dir, "orders").select("o_orderkey")
    return add_surrogate_key(orders, "o_orderkey", "OrderKey", layout="packed")


# --- dimensions ------------------------------------------------------------


@query("dim_customers")
def dim_customers(spark, sf_dir):
    return build_dim_customers(raw_tables(spark, sf_dir, dirty=True)["customers"])


@query("dim_products")
def dim_products(spark, sf_dir):
    return build_dim_products(raw_tables(spark, sf_dir, dirty=True)["products"])


@query("dim_sellers")
def dim_sellers(spark, sf_dir):
    return build_dim_sellers(raw_tables(spark, sf_dir, dirty=True)["sellers"])


def _dim_date(spark, sf_dir, **options):
    raw = raw_tables(spark, sf_dir, dirty=True)
    return build_dim_date(sold_dates(raw["order_items"], parse_purchase_timestamps(raw["orders"])), **options)


@query("dim_date")
def dim_date(spark, sf_dir):
    return _dim_date(spark, sf_dir)


@query("dim_date_known_only")
def dim_date_known_only(spark, sf_dir):
    return _dim_date(spark, sf_dir, keep_null_member=False)


@query("dim_key_uniqueness")
def dim_key_uniqueness(spark, sf_dir):
    star = _star(spark, sf_dir)
    keys = {
        "dim_customers": ("customer_id", "CustomerKey"),
        "dim_products": ("product_id", "ProductKey"),
        "dim_sellers": ("seller_id", "SellerKey"),
        "dim_date": ("Date", "DateKey"),
    }
    return reduce(
        DataFrame.unionAll,
        [
            duplicate_groups(getattr(star, name), key)
            .agg(F.count("*").alias("repeated"))
            .select(F.lit(name).alias("table_name"), F.lit(key).alias("key"), "repeated")
            for name, pair in keys.items()
            for key in pair
        ],
    )


# --- fact ------------------------------------------------------------------


@query("fact_base")
def fact_base(spark, sf_dir):
    raw = raw_tables(spark, sf_dir, dirty=True)
    base = build_fact_base(cast_measures(raw["order_items"]), parse_purchase_timestamps(raw["orders"]))
    return _plain_time(base, "order_purchase_ts")


@query("join_using_columns")
def join_using_columns(spark, sf_dir):
    raw = raw_tables(spark, sf_dir)
    return raw["order_items"].join(raw["orders"], "order_id")


@query("fact_order_items")
def fact_order_items(spark, sf_dir):
    return _star(spark, sf_dir, dirty=False).fact_order_items


@query("fact_order_items_dirty")
def fact_order_items_dirty(spark, sf_dir):
    return _star(spark, sf_dir, missing=True).fact_order_items


@query("star_counts")
def star_counts(spark, sf_dir):
    return load_counts(_star(spark, sf_dir).tables())


# --- checks ----------------------------------------------------------------


@query("quality_checks")
def quality_checks(spark, sf_dir):
    return _checked(spark, sf_dir)


@query("quality_checks_packed")
def quality_checks_packed(spark, sf_dir):
    return _checked(spark, sf_dir, layout="packed")


@query("quality_checks_by_grain")
def quality_checks_by_grain(spark, sf_dir):
    """The checks of a fact laid out by its grain: nothing but sums is exchanged."""
    star = _star(spark, sf_dir, missing=True)
    star.lay_out_fact()
    return star.quality_checks


@query("run_report")
def run_report(spark, sf_dir):
    """Rows loaded from each raw table and what became of the purchase times, as a run saw them pass."""
    report = run_star(spark, raw_tables(spark, sf_dir, dirty=True)).report
    return _row(spark, **report.loaded, **{name: n for name, n in report.parsed.items() if name != "total_orders"})


@query("fact_duplicates")
def fact_duplicates(spark, sf_dir):
    raw = raw_tables(spark, sf_dir)
    base = raw["order_items"].join(raw["orders"], "order_id")
    return duplicate_groups(base, "order_id", "order_item_id")


@query("fk_orphans")
def fk_orphans(spark, sf_dir):
    raw = raw_tables(spark, sf_dir, dirty=True, missing=True)
    relations = (
        ("order_items", "order_id", "orders"),
        ("order_items", "product_id", "products"),
        ("order_items", "seller_id", "sellers"),
        ("orders", "customer_id", "customers"),
    )
    return reduce(
        DataFrame.unionAll,
        [
            orphans(raw[child], raw[parent], key, key).select(
                F.lit(f"{child}.{key}").alias("relation"), "orphan_keys", "orphan_rows"
            )
            for child, key, parent in relations
        ],
    )


# --- sinks -----------------------------------------------------------------


@query("publish_star_counts")
def publish_star_counts(spark, sf_dir):
    target = new_scratch(spark)
    publish_parquet(_star(spark, sf_dir).tables(), target)
    return load_counts(read_published(spark, target))


@query("sink_full_refresh")
def sink_full_refresh(spark, sf_dir):
    """Two runs into one target; the second, cleaner one replaces the first."""
    target = new_scratch(spark)
    publish_parquet(_star(spark, sf_dir).tables(), target)
    version = publish_parquet(_star(spark, sf_dir, dirty=False).tables(), target)
    return load_counts(read_published(spark, target)).withColumn("version", F.lit(version).cast("bigint"))


@query("export_csv_dim")
def export_csv_dim(spark, sf_dir):
    path = new_scratch(spark)
    dim = build_dim_sellers(raw_tables(spark, sf_dir, dirty=True)["sellers"])
    export_csv(dim, path)
    return scan_csv(spark, path, dim.schema)


@query("export_text_dims")
def export_text_dims(spark, sf_dir):
    """The lines of two dimensions in the warehouse's export format."""
    raw = raw_tables(spark, sf_dir, dirty=True)
    lines = []
    for name, dim in (("dim_sellers", build_dim_sellers(raw["sellers"])), ("dim_date", _dim_date(spark, sf_dir))):
        path = new_scratch(spark)
        export_text(dim, path)
        lines.append(spark.read.text(path).distinct().select(F.lit(name).alias("name"), F.col("value").alias("line")))
    return reduce(DataFrame.unionAll, lines)


@query("publish_fact")
def publish_fact(spark, sf_dir):
    """The published fact, read back with all its columns."""
    target = new_scratch(spark)
    publish_parquet(_star(spark, sf_dir).tables(), target)
    return read_published(spark, target)["fact_order_items"]


@query("publish_dim_date")
def publish_dim_date(spark, sf_dir):
    target = new_scratch(spark)
    publish_parquet(_star(spark, sf_dir).tables(), target)
    return read_published(spark, target)["dim_date"]


@query("publish_verified")
def publish_verified(spark, sf_dir):
    """Each published table held against the rows and digest taken when it was written."""
    target = new_scratch(spark)
    publish_parquet(_star(spark, sf_dir).tables(), target)
    return verify_published(spark, target)


# --- rollups ---------------------------------------------------------------


@query("mart_sales_by_month")
def mart_sales_by_month(spark, sf_dir):
    return _star(spark, sf_dir).rollup("sales_by_month")


@query("mart_product_performance")
def mart_product_performance(spark, sf_dir):
    return _star(spark, sf_dir).rollup("product_performance")


@query("mart_customer_behavior")
def mart_customer_behavior(spark, sf_dir):
    return _star(spark, sf_dir).rollup("customer_behavior")


@query("mart_status_mix")
def mart_status_mix(spark, sf_dir):
    return _star(spark, sf_dir).rollup("status_mix")


@query("marts_by_grain")
def marts_by_grain(spark, sf_dir):
    """Two rollups by order over one fact that lies by order."""
    star = _star(spark, sf_dir)
    star.lay_out_fact()
    by_status = star.rollup("status_mix").select(F.lit("status").alias("by"), F.col("order_status").alias("member"), "items", "orders", "revenue")
    month = F.concat_ws("-", F.col("Year").cast("string"), F.col("Month").cast("string"))
    by_month = star.rollup("sales_by_month").select(F.lit("month").alias("by"), month.alias("member"), "items", "orders", "revenue")
    return by_status.unionAll(by_month)
