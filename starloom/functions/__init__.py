"""Column functions and cleaning steps."""

from starloom.functions.calendar import calendar_parts
from starloom.functions.clean import (
    cast_measures,
    normalize_text,
    parse_check,
    parse_metrics,
    parse_purchase_timestamps,
    parse_timestamp,
    zip_prefix,
)

__all__ = [
    "calendar_parts",
    "cast_measures",
    "normalize_text",
    "parse_check",
    "parse_metrics",
    "parse_purchase_timestamps",
    "parse_timestamp",
    "zip_prefix",
]
