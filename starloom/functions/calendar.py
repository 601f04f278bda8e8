"""Calendar attributes of a date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def calendar_parts(date: str) -> list[Column]:
    """Year, Month, Day, Weekday (1 = Sunday) and Quarter of a date column."""
    return [
        F.year(date).alias("Year"),
        F.month(date).alias("Month"),
        F.dayofmonth(date).alias("Day"),
        F.dayofweek(date).alias("Weekday"),
        F.quarter(date).alias("Quarter"),
    ]
