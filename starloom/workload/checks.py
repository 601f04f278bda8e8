"""The same questions in SQL over the benchmark tables, for an outside engine.

Written from the definitions, not from the Spark plans: keys are plain
``row_number`` ranks and survivors the first row of an ordered partition.
"""

from __future__ import annotations

CLEAN_RAW = {
    "raw_items": """
        SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
               l_suppkey AS seller_id, l_extendedprice AS price, l_tax AS freight_value
        FROM lineitem""",
    "raw_orders": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS order_status,
               date_trunc('minute', o_orderdate)::timestamp AS order_purchase_ts
        FROM orders""",
    "raw_customers": """
        SELECT c_custkey AS customer_id, c_name AS customer_unique_id,
               c_nationkey::varchar AS customer_zip_code_prefix,
               c_mktsegment AS customer_city, n_name AS customer_state
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "raw_sellers": """
        SELECT s_suppkey AS seller_id, s_nationkey::varchar AS seller_zip_code_prefix,
               s_name AS seller_city, n_name AS seller_state
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "raw_products": """
        SELECT p_partkey AS product_id, p_type AS product_category_name,
               length(p_name)::int AS product_name_lenght, length(p_brand)::int AS product_description_lenght,
               floor(p_retailprice)::int AS product_photos_qty, p_size::int AS product_weight_g,
               p_size::int AS product_length_cm, length(p_name)::int AS product_height_cm,
               length(p_brand)::int AS product_width_cm
        FROM part""",
}

# Orders whose purchase time is absent, and those whose text has another format.
NO_TIME = "(o_orderpriority = '5-LOW' AND o_orderstatus = 'P')"
ODD_TIME = "o_orderpriority = '1-URGENT'"

DIRTY_RAW = {
    "raw_items": CLEAN_RAW["raw_items"],
    "raw_orders": f"""
        SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS order_status,
               CASE WHEN {ODD_TIME} OR {NO_TIME} THEN NULL
                    ELSE date_trunc('minute', o_orderdate)::timestamp END AS order_purchase_ts
        FROM orders""",
    "raw_customers": """
        SELECT c_custkey AS customer_id, name AS customer_unique_id,
               c_nationkey::varchar AS customer_zip_code_prefix,
               '  ' || lower(c_mktsegment) || ' ' AS customer_city, '  ' || lower(n_name) || ' ' AS customer_state
        FROM (SELECT *, c_name AS name FROM customer
              UNION ALL SELECT *, c_name || '/2' FROM customer WHERE c_acctbal < 0) c
        JOIN nation ON c_nationkey = n_nationkey""",
    "raw_sellers": """
        SELECT s_suppkey AS seller_id, s_nationkey::varchar AS seller_zip_code_prefix,
               '  ' || lower(name) || ' ' AS seller_city, '  ' || lower(n_name) || ' ' AS seller_state
        FROM (SELECT *, s_name AS name FROM supplier
              UNION ALL SELECT *, 'Acme ' || s_name FROM supplier WHERE s_acctbal < 0) s
        JOIN nation ON s_nationkey = n_nationkey""",
    "raw_products": """
        SELECT p_partkey AS product_id, '  ' || lower(kind) || ' ' AS product_category_name,
               length(p_name)::int AS product_name_lenght, length(p_brand)::int AS product_description_lenght,
               floor(p_retailprice)::int AS product_photos_qty, p_size::int AS product_weight_g,
               p_size::int AS product_length_cm, length(p_name)::int AS product_height_cm,
               length(p_brand)::int AS product_width_cm
        FROM (SELECT *, CASE WHEN p_brand = 'Brand#1' THEN NULL ELSE p_type END AS kind FROM part
              UNION ALL SELECT *, 'aged' FROM part WHERE p_size <= 5) p""",
}

PRODUCT_SIZES = (
    "product_name_lenght, product_description_lenght, product_photos_qty, product_weight_g, "
    "product_length_cm, product_height_cm, product_width_cm"
)


def _survivors(table: str, key: str, rest: str) -> str:
    order = ", ".join(f"{c.strip()} ASC NULLS FIRST" for c in rest.split(","))
    return (
        f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS copy FROM {table}) "
        "WHERE copy = 1)"
    )


STAR = {
    "dim_customers": f"""
        SELECT row_number() OVER (ORDER BY customer_id NULLS LAST) AS "CustomerKey", customer_id, customer_unique_id,
               customer_zip_code_prefix, upper(trim(customer_city)) AS customer_city,
               upper(trim(customer_state)) AS customer_state
        FROM {_survivors("raw_customers", "customer_id",
                         "customer_unique_id, customer_zip_code_prefix, customer_city, customer_state")}""",
    "dim_products": f"""
        SELECT product_id, upper(trim(product_category_name)) AS product_category_name, {PRODUCT_SIZES},
               row_number() OVER (ORDER BY product_id NULLS LAST) AS "ProductKey"
        FROM {_survivors("raw_products", "product_id", "product_category_name, " + PRODUCT_SIZES)}""",
    "dim_sellers": f"""
        SELECT seller_id, seller_zip_code_prefix, upper(trim(seller_city)) AS seller_city,
               upper(trim(seller_state)) AS seller_state,
               row_number() OVER (ORDER BY seller_id NULLS LAST) AS "SellerKey"
        FROM {_survivors("raw_sellers", "seller_id", "seller_zip_code_prefix, seller_city, seller_state")}""",
    "base": """
        SELECT order_id, order_item_id, product_id, customer_id, price, seller_id, order_status, freight_value,
               order_purchase_ts
        FROM raw_items JOIN raw_orders USING (order_id)""",
    "dim_date": """
        SELECT "Date", year("Date")::int AS "Year", month("Date")::int AS "Month", day("Date")::int AS "Day",
               (dayofweek("Date") + 1)::int AS "Weekday", quarter("Date")::int AS "Quarter",
               row_number() OVER (ORDER BY "Date" NULLS LAST) AS "DateKey"
        FROM (SELECT DISTINCT order_purchase_ts::date AS "Date" FROM base)""",
    "fact": """
        SELECT order_id, order_item_id, price, order_status, freight_value,
               "CustomerKey", "ProductKey", "SellerKey", "DateKey"
        FROM base
        LEFT JOIN dim_customers USING (customer_id)
        LEFT JOIN dim_products USING (product_id)
        LEFT JOIN dim_sellers USING (seller_id)
        LEFT JOIN dim_date ON base.order_purchase_ts::date = dim_date."Date\"""",
}


def _with(body: str, dirty: bool = True, star: bool = True, missing: bool = False) -> str:
    steps = {**(DIRTY_RAW if dirty else CLEAN_RAW), **(STAR if star else {})}
    if missing:
        steps["raw_customers"] += " WHERE c_mktsegment <> 'BUILDING'"
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in steps.items()) + "\n" + body


def _counts(tables: dict[str, str], extra: str = "") -> str:
    return "\nUNION ALL\n".join(f"SELECT '{name}' AS \"name\", count(*) AS n{extra} FROM {t}" for name, t in tables.items())


STAR_COUNTS = {t: t for t in ("dim_customers", "dim_products", "dim_sellers", "dim_date")} | {"fact_order_items": "fact"}

QUALITY = """
    SELECT count(*) FILTER ("CustomerKey" IS NULL) AS "CustomerKey",
           count(*) FILTER ("ProductKey" IS NULL) AS "ProductKey",
           count(*) FILTER ("SellerKey" IS NULL) AS "SellerKey",
           count(*) FILTER ("DateKey" IS NULL) AS "DateKey",
           (SELECT count(*) FROM (SELECT 1 FROM fact GROUP BY order_id, order_item_id HAVING count(*) > 1))
               AS duplicates
    FROM fact"""


def _money(column: str, alias: str) -> str:
    return f"sum({column}::decimal(18,2))::double AS {alias}"


def _orphans(relation: str, child: str, parent: str, key: str) -> str:
    return f"""
        SELECT '{relation}' AS relation, count(DISTINCT {key}) AS orphan_keys, count(*) AS orphan_rows
        FROM {child} c WHERE {key} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = c.{key})"""


def _repeated(table: str, key: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, '{key}' AS \"key\", "
        f'count(*) AS repeated FROM (SELECT 1 FROM {table} GROUP BY "{key}" HAVING count(*) > 1)'
    )


def _murmur3_of_bigint(table: str, key: str) -> str:
    """CTEs that end in ``hashed(key, h)``: Murmur3 x86_32 of a bigint, signed.

    Plain arithmetic modulo 2^32, one step per CTE. Fixed values: the
    published constants of the algorithm, and seed 42.
    """
    mod = 4294967296
    steps: list[str] = [f"s0 AS (SELECT {key} AS key, {key}::hugeint AS wide, 42::hugeint AS h FROM {table})"]

    def step(expression: str, name: str = "h", keep: str = "h") -> None:
        carried = "" if name == keep else f"{keep}, "
        steps.append(f"s{len(steps)} AS (SELECT key, wide, {carried}({expression}) AS {name} FROM s{len(steps) - 1})")

    def rotated(column: str, bits: int) -> str:
        return f"({column} * {2**bits}) % {mod} + {column} // {2 ** (32 - bits)}"

    def xored(left: str, right: str) -> str:
        return f"xor(({left})::bigint, ({right})::bigint)::hugeint"

    low = f"((wide % {mod}) + {mod}) % {mod}"
    high = f"(((wide + {2**64}) % {2**64}) // {mod})"
    for word in (low, high):
        step(f"({word}) * 3432918353 % {mod}", "k")
        step(rotated("k", 15), "k")
        step(f"k * 461845907 % {mod}", "k")
        steps.append(f"s{len(steps)} AS (SELECT key, wide, {xored('h', 'k')} AS h FROM s{len(steps) - 1})")
        step(rotated("h", 13))
        step(f"(h * 5 + 3864292196) % {mod}")
    step(xored("h", "8"))
    step(xored("h", "h // 65536"))
    step(f"h * 2246822507 % {mod}")
    step(xored("h", "h // 8192"))
    step(f"h * 3266489909 % {mod}")
    step(xored("h", "h // 65536"))
    last = len(steps) - 1
    steps.append(f"hashed AS (SELECT key, CASE WHEN h >= {mod // 2} THEN h - {mod} ELSE h END AS h FROM s{last})")
    return ",\n".join(steps)


CHECKS: dict[str, str] = {
    # sources
    "load_counts": _with(
        _counts({"orders": "raw_orders", "order_items": "raw_items", "customers": "raw_customers",
                 "products": "raw_products", "sellers": "raw_sellers"}),
        dirty=False, star=False,
    ),
    "load_counts_tables": _counts(
        {t: t for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    ),
    "scan_csv": _with(
        "SELECT order_id::varchar AS order_id, order_item_id::int AS order_item_id, product_id::varchar AS product_id, "
        "seller_id::varchar AS seller_id, price, freight_value FROM raw_items",
        dirty=False, star=False,
    ),
    "scan_csv_inferred": _with(
        "SELECT seller_id::int AS seller_id, seller_zip_code_prefix::int AS seller_zip_code_prefix, seller_city, "
        "seller_state FROM raw_sellers",
        dirty=False, star=False,
    ),
    # cleaning
    "cast_measures": "SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, "
    "l_extendedprice::varchar::double AS price, l_tax::varchar::double AS freight_value FROM lineitem",
    "scan_rejects": "SELECT count(*) AS n_rows, count(*) FILTER (l_linenumber = 3) AS n_rejects FROM lineitem",
    "cast_measures_null": "SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, try_cast(CASE WHEN "
    "l_linenumber = 3 THEN 'abc' ELSE l_extendedprice::varchar END AS double) AS price, "
    "l_tax::varchar::double AS freight_value FROM lineitem",
    "parse_purchase_ts": _with("SELECT order_id, order_purchase_ts FROM raw_orders", star=False),
    "parse_check": f"SELECT count(*) AS total_orders, count(*) FILTER ({ODD_TIME} OR {NO_TIME}) AS null_dates, "
    f"count(*) FILTER ({ODD_TIME}) AS parse_failures, count(*) FILTER ({NO_TIME}) AS null_sources FROM orders",
    "normalize_text": _with(
        "SELECT customer_id, upper(trim(customer_city)) AS customer_city, upper(trim(customer_state)) AS "
        "customer_state FROM raw_customers",
        star=False,
    ),
    "zip_prefix_styles": "SELECT c_custkey AS customer_id, c_nationkey::varchar AS zip_text, "
    "lpad(c_nationkey::varchar, 5, '0') AS zip_padded, c_nationkey::int AS zip_int FROM customer",
    # keys and deduplication
    "dedup_natural_key": "SELECT c_nationkey, c_mktsegment, c_name FROM (SELECT *, row_number() OVER (PARTITION BY "
    "c_nationkey ORDER BY c_mktsegment, c_name) AS copy FROM customer) WHERE copy = 1",
    "distinct_purchase_ts": _with("SELECT DISTINCT order_purchase_ts FROM raw_orders", star=False),
    "surrogate_key_dense": 'SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS "OrderKey" FROM orders',
    "surrogate_key_string": 'SELECT text, row_number() OVER (ORDER BY text) AS "TextKey" '
    "FROM (SELECT DISTINCT text FROM documents)",
    "surrogate_key_hex": 'SELECT order_id, row_number() OVER (ORDER BY order_id) AS "OrderKey" '
    "FROM (SELECT md5(o_orderkey::varchar) AS order_id FROM orders)",
    "surrogate_key_packed": "WITH " + _murmur3_of_bigint("orders", "o_orderkey") + ",\n"
    "buckets AS (SELECT key, (((h % 200) + 200) % 200)::bigint AS bucket FROM hashed)\n"
    "SELECT key AS o_orderkey, bucket * 8589934592 + row_number() OVER (PARTITION BY bucket ORDER BY key) "
    'AS "OrderKey" FROM buckets',
    # dimensions
    "dim_customers": _with("SELECT * FROM dim_customers"),
    "dim_products": _with("SELECT * FROM dim_products"),
    "dim_sellers": _with("SELECT * FROM dim_sellers"),
    "dim_date": _with("SELECT * FROM dim_date"),
    "dim_date_known_only": _with('SELECT * FROM dim_date WHERE "Date" IS NOT NULL'),
    "dim_key_uniqueness": _with(
        "\nUNION ALL\n".join(
            _repeated(table, key)
            for table, pair in {
                "dim_customers": ("customer_id", "CustomerKey"),
                "dim_products": ("product_id", "ProductKey"),
                "dim_sellers": ("seller_id", "SellerKey"),
                "dim_date": ("Date", "DateKey"),
            }.items()
            for key in pair
        )
    ),
    # fact
    "fact_base": _with("SELECT * FROM base"),
    "join_using_columns": "SELECT i.order_id, order_item_id, product_id, seller_id, price, freight_value, "
    "o_custkey AS customer_id, o_orderstatus AS order_status, strftime(o_orderdate, '%-m/%-d/%Y %-H:%M') AS "
    "order_purchase_timestamp FROM (" + CLEAN_RAW["raw_items"] + ") i JOIN orders ON i.order_id = o_orderkey",
    "fact_order_items": _with("SELECT * FROM fact", dirty=False),
    "fact_order_items_dirty": _with("SELECT * FROM fact", missing=True),
    "star_counts": _with(_counts(STAR_COUNTS)),
    # checks
    "quality_checks": _with(QUALITY, missing=True),
    "quality_checks_packed": _with(QUALITY, missing=True),
    "quality_checks_by_grain": _with(QUALITY, missing=True),
    "fact_duplicates": _with(
        "SELECT order_id, order_item_id, count(*) AS n FROM base GROUP BY order_id, order_item_id HAVING count(*) > 1",
        dirty=False,
    ),
    "fk_orphans": _with(
        "\nUNION ALL\n".join(
            [
                _orphans("order_items.order_id", "raw_items", "raw_orders", "order_id"),
                _orphans("order_items.product_id", "raw_items", "raw_products", "product_id"),
                _orphans("order_items.seller_id", "raw_items", "raw_sellers", "seller_id"),
                _orphans("orders.customer_id", "raw_orders", "raw_customers", "customer_id"),
            ]
        ),
        star=False,
        missing=True,
    ),
    "run_report": _with(
        "SELECT (SELECT count(*) FROM raw_orders) AS orders, (SELECT count(*) FROM raw_items) AS order_items, "
        "(SELECT count(*) FROM raw_customers) AS customers, (SELECT count(*) FROM raw_products) AS products, "
        "(SELECT count(*) FROM raw_sellers) AS sellers, "
        f"count(*) FILTER ({ODD_TIME} OR {NO_TIME}) AS null_dates, count(*) FILTER ({ODD_TIME}) AS parse_failures, "
        f"count(*) FILTER ({NO_TIME}) AS null_sources FROM orders",
        star=False,
    ),
    # sinks
    "publish_fact": _with("SELECT * FROM fact"),
    "publish_dim_date": _with("SELECT * FROM dim_date"),
    "publish_verified": _with(
        "\nUNION ALL\n".join(f"SELECT '{n}' AS \"name\", count(*) AS \"rows\", true AS intact FROM {t}" for n, t in STAR_COUNTS.items())
    ),
    "export_text_dims": _with(
        """SELECT 'dim_sellers' AS "name", '"seller_id","seller_zip_code_prefix","seller_city","seller_state","SellerKey"' AS line
        UNION ALL SELECT 'dim_sellers', concat('"', seller_id, '","', seller_zip_code_prefix, '","', seller_city, '","',
            seller_state, '","', "SellerKey", '"') FROM dim_sellers
        UNION ALL SELECT 'dim_date', '"Date","Year","Month","Day","Weekday","Quarter","DateKey"'
        UNION ALL SELECT 'dim_date', concat_ws(',', coalesce('"' || "Date"::varchar || '"', ''), coalesce("Year"::varchar, ''),
            coalesce("Month"::varchar, ''), coalesce("Day"::varchar, ''), coalesce("Weekday"::varchar, ''),
            coalesce("Quarter"::varchar, ''), '"' || "DateKey" || '"') FROM dim_date"""
    ),
    "publish_star_counts": _with(_counts(STAR_COUNTS)),
    "sink_full_refresh": _with(_counts(STAR_COUNTS, ", 2::bigint AS version"), dirty=False),
    "export_csv_dim": _with("SELECT * FROM dim_sellers"),
    # rollups
    "mart_sales_by_month": _with(
        f'SELECT "Year", "Month", count(*) AS items, count(DISTINCT order_id) AS orders, {_money("price", "revenue")} '
        'FROM fact LEFT JOIN dim_date USING ("DateKey") GROUP BY "Year", "Month"'
    ),
    "mart_product_performance": _with(
        f"SELECT product_category_name, count(*) AS items, {_money('price', 'revenue')}, "
        f"{_money('freight_value', 'freight')} FROM base LEFT JOIN dim_products USING (product_id) "
        "GROUP BY product_category_name"
    ),
    "mart_customer_behavior": _with(
        f'SELECT dim_customers.customer_id, count(DISTINCT order_id) AS orders, count(*) AS items, '
        f'{_money("price", "revenue")} FROM fact LEFT JOIN dim_customers USING ("CustomerKey") '
        "GROUP BY dim_customers.customer_id"
    ),
    "marts_by_grain": _with(
        f"SELECT 'status' AS \"by\", order_status AS member, count(*) AS items, count(DISTINCT order_id) AS orders, "
        f"{_money('price', 'revenue')} FROM base GROUP BY order_status UNION ALL "
        'SELECT \'month\', concat_ws(\'-\', "Year", "Month"), count(*), count(DISTINCT order_id), '
        f'{_money("price", "revenue")} FROM fact LEFT JOIN dim_date USING ("DateKey") GROUP BY "Year", "Month"'
    ),
    "mart_status_mix": _with(
        f"SELECT order_status, count(*) AS items, count(DISTINCT order_id) AS orders, {_money('price', 'revenue')} "
        "FROM base GROUP BY order_status"
    ),
}
