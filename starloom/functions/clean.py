"""Casting, timestamp parsing and text normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The raw order feed's timestamp format and its measures.
PURCHASE_FORMAT = "M/d/yyyy H:mm"
MEASURES = ("price", "freight_value")


def cast_measures(df: DataFrame, columns: Sequence[str] = MEASURES, on_error: str = "fail") -> DataFrame:
    """Cast columns to double; malformed text fails the job or becomes NULL, whatever the session's ANSI mode."""
    if on_error == "fail":
        return df.withColumns({c: _cast_or_fail(c) for c in columns})
    if on_error == "null":
        return df.withColumns({c: F.col(c).try_cast("double") for c in columns})
    raise ValueError(f"on_error must be 'fail' or 'null', not {on_error!r}")


def _cast_or_fail(column: str) -> Column:
    number = F.col(column).try_cast("double")
    malformed = F.concat(F.lit(f"CAST_INVALID_INPUT: {column} is not a number: "), F.col(column).cast("string"))
    return F.when(F.col(column).isNotNull() & number.isNull(), F.raise_error(malformed)).otherwise(number)


def normalize_text(column: Column | str) -> Column:
    """Upper-case and strip outer spaces; inner spaces and accents stay."""
    return F.trim(F.upper(column))


def zip_prefix(column: Column | str, style: str = "text") -> Column:
    """Zip prefix as read, padded to five digits, or as a number.

    ``int`` gives what type inference would give: leading zeros are lost.
    """
    text = F.col(column) if isinstance(column, str) else column
    if style == "text":
        return text
    if style == "padded":
        return F.lpad(text.cast("string"), 5, "0")
    if style == "int":
        return text.cast("int")
    raise ValueError(f"style must be 'text', 'padded' or 'int', not {style!r}")


def parse_timestamp(df: DataFrame, source: str, target: str, formats: Sequence[str] = (PURCHASE_FORMAT,)) -> DataFrame:
    """Add ``target``: the first format that fits ``source``, else NULL.

    A source that already is a timestamp passes through unchanged.
    """
    attempts = [F.try_to_timestamp(F.col(source), F.lit(fmt)) for fmt in formats]
    return df.withColumn(target, attempts[0] if len(attempts) == 1 else F.coalesce(*attempts))


def parse_purchase_timestamps(orders: DataFrame) -> DataFrame:
    """Add ``order_purchase_ts`` to the raw orders."""
    return parse_timestamp(orders, "order_purchase_timestamp", "order_purchase_ts")


def parse_check(parsed: DataFrame, source: str, target: str) -> DataFrame:
    """One row of parse counts, taken in one pass over the parsed table.

    ``null_dates`` is every NULL result; ``parse_failures`` leaves out the
    rows whose source was NULL to begin with, which ``null_sources`` counts.
    """
    return parsed.agg(F.count("*").alias("total_orders"), *[m.alias(name) for name, m in parse_metrics(source, target).items()])


def parse_metrics(source: str, target: str) -> dict[str, Column]:
    """The aggregates of :func:`parse_check` but for the row count."""
    failed = F.col(target).isNull()
    empty = F.col(source).isNull()
    return {
        "null_dates": F.count_if(failed),
        "parse_failures": F.count_if(failed & ~empty),
        "null_sources": F.count_if(empty),
    }
