"""Columns the engine reads from each raw table.

Measures and the purchase time stay text here: cleaning decides what becomes
of malformed values. Zip prefixes are text so that leading zeros survive.
"""

from __future__ import annotations

from pyspark.sql.types import IntegerType, StringType, StructField, StructType


def _struct(**columns) -> StructType:
    return StructType([StructField(name, dtype) for name, dtype in columns.items()])


_text, _int = StringType(), IntegerType()

# The names, misspellings included, are part of the data contract.
SOURCE_SCHEMAS = {
    "orders": _struct(
        order_id=_text,
        customer_id=_text,
        order_status=_text,
        order_purchase_timestamp=_text,
    ),
    "order_items": _struct(
        order_id=_text,
        order_item_id=_int,
        product_id=_text,
        seller_id=_text,
        price=_text,
        freight_value=_text,
    ),
    "customers": _struct(
        customer_id=_text,
        customer_unique_id=_text,
        customer_zip_code_prefix=_text,
        customer_city=_text,
        customer_state=_text,
    ),
    "products": _struct(
        product_id=_text,
        product_category_name=_text,
        product_name_lenght=_int,
        product_description_lenght=_int,
        product_photos_qty=_int,
        product_weight_g=_int,
        product_length_cm=_int,
        product_height_cm=_int,
        product_width_cm=_int,
    ),
    "sellers": _struct(
        seller_id=_text,
        seller_zip_code_prefix=_text,
        seller_city=_text,
        seller_state=_text,
    ),
}

SOURCE_TABLES = tuple(SOURCE_SCHEMAS)
