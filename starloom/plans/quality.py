"""Checks of the fact, returned as data."""

from __future__ import annotations

import logging
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.plans.layout import PART

logger = logging.getLogger(__name__)

FOREIGN_KEYS = ("CustomerKey", "ProductKey", "SellerKey", "DateKey")
GRAIN = ("order_id", "order_item_id")


class QualityError(RuntimeError):
    """Raised by the ``fail`` gate."""


def quality_checks(fact: DataFrame) -> DataFrame:
    """One row: NULLs per foreign key, and grain groups with several rows.

    The NULLs are counted without a shuffle of rows, and the grain alone is
    shuffled, so pass a written fact: a lazy one is computed for both. The struct
    makes Spark shuffle on the whole grain after a map-side count, so one hot
    order spreads out.
    """
    none = F.lit(0).cast("bigint")
    nulls = fact.agg(*[m.alias(k) for k, m in null_metrics().items()], none.alias("duplicates"))
    repeated = repeated_grains(fact).select(*[none.alias(k) for k in FOREIGN_KEYS], "duplicates")
    return nulls.unionAll(repeated).agg(*[F.sum(c).alias(c) for c in (*FOREIGN_KEYS, "duplicates")])


def null_metrics() -> dict[str, Column]:
    """The NULLs of each foreign key, as aggregates to take while the fact is written."""
    return {k: F.count_if(F.col(k).isNull()) for k in FOREIGN_KEYS}


def repeated_grains(fact: DataFrame) -> DataFrame:
    """One row: the grain groups with several rows. Only the grain is read, and shuffled unless the fact lies by it."""
    grain = [*GRAIN, PART] if PART in fact.columns else [F.struct(*GRAIN).alias("grain")]
    groups = fact.groupBy(*grain).agg(F.count("*").alias("n"))
    return groups.agg(F.count_if(F.col("n") > 1).alias("duplicates"))


def quality_findings(checks: DataFrame | Mapping[str, int], gate: str = "warn") -> dict[str, int]:
    """Run the checks, or take what was found; log what is not zero, and raise if ``gate`` is fail."""
    if gate not in ("warn", "fail"):
        raise ValueError(f"gate must be 'warn' or 'fail', not {gate!r}")
    found = checks.first().asDict() if isinstance(checks, DataFrame) else dict(checks)
    problems = {name: n for name, n in found.items() if n}
    for name, n in problems.items():
        if name == "duplicates":
            logger.warning("%d (order_id, order_item_id) groups hold several fact rows", n)
        else:
            logger.warning("%d fact rows have a NULL %s", n, name)
    if problems and gate == "fail":
        raise QualityError(f"quality checks are not zero: {problems}")
    return found
