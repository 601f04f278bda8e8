"""One run: load, build, check and, if asked, publish."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from starloom.operators import freeze
from starloom.plans.quality import null_metrics, quality_findings, repeated_grains
from starloom.plans.star import Star, build_star
from starloom.session import drop_scratch, tune, widen_shuffle
from starloom.sinks import publish_jdbc, publish_version, read_version
from starloom.sources import SOURCE_TABLES, load_sources
from starloom.sources.watch import Watch


@dataclass(frozen=True)
class RunReport:
    """What a run found out while the rows passed.

    ``loaded`` rows by raw table, ``parsed`` the counts of ``parse_check``, and
    ``findings`` the quality checks. ``version`` is that of a Parquet publish.
    """

    loaded: dict[str, int]
    parsed: dict[str, int]
    findings: dict[str, int]
    version: int | None = None


def run_star(
    spark: SparkSession,
    source: str | dict[str, DataFrame],
    target: str | Mapping[str, str] | None = None,
    publish: bool = False,
    gate: str = "warn",
    *,
    fmt: str = "csv",
    pattern: str = "{table}.{fmt}",
    infer_schema: bool = False,
    **options,
) -> Star:
    """Build the star from a folder of raw tables, or from loaded tables.

    With ``publish`` it goes to ``target``: a folder for Parquet, a mapping
    of connection options for JDBC. Without, the checks alone run. The fact is
    written once, to the Parquet target or else to the run's scratch path, so
    checks and sinks read it instead of joining again, and after a Parquet
    publish the star holds the published tables. Row counts, parse failures
    and NULL keys are taken while the rows pass, without a scan of their own;
    ``star.report`` holds them. ``infer_schema`` lets Spark choose the types of CSV.

    A run that fails, also at the gate, deletes its scratch path. Call
    ``drop_scratch(spark, star.scratch)`` when the returned tables are no longer needed.
    """
    tune(spark)
    sources = load_sources(spark, source, fmt, pattern, infer_schema) if isinstance(source, str) else source
    widen_shuffle(spark, sources)
    if publish and target is None:
        raise ValueError("publish needs a target")
    watch, version = Watch(), None
    star = build_star(sources, watch=watch, **options)
    try:
        if publish and isinstance(target, str):
            published = publish_version(star.tables(), target, gate)
            star.keep(**read_version(spark, target, published.run))
            findings, version = published.findings, published.version
        else:
            findings = _written_fact(star, watch)
            if publish:
                publish_jdbc(star.tables(), target, gate=gate, findings=findings)
            else:
                quality_findings(findings, gate)
        loaded = {name: watch.result(name)["rows"] for name in SOURCE_TABLES}
        orders = watch.result("orders")
        parsed = {"total_orders": orders.pop("rows"), **orders}
    except Exception:
        drop_scratch(spark, star.scratch)
        raise
    star.report = RunReport(loaded, parsed, findings, version)
    return star


def _written_fact(star: Star, watch: Watch) -> dict[str, int]:
    """Write the fact below the star's scratch path, and check it on the way."""
    lazy = watch("fact_order_items", star.fact_order_items, **null_metrics())
    star.keep(fact_order_items=freeze(lazy, f"{star.scratch}/fact_order_items"))
    nulls = watch.result("fact_order_items")
    nulls.pop("rows")
    return {**nulls, **repeated_grains(star.fact_order_items).first().asDict()}
