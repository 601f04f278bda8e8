"""A star-schema engine for order data, written for Spark."""

from starloom.plans import Star, build_star, quality_checks, quality_findings
from starloom.run import RunReport, run_star
from starloom.session import drop_scratch, local_session, tune
from starloom.sinks import clean_published, export_csv, export_text, publish_jdbc, publish_parquet, read_published, verify_published
from starloom.sources import load_sources

__all__ = [
    "RunReport",
    "Star",
    "build_star",
    "clean_published",
    "drop_scratch",
    "export_csv",
    "export_text",
    "load_sources",
    "local_session",
    "publish_jdbc",
    "publish_parquet",
    "quality_checks",
    "quality_findings",
    "read_published",
    "run_star",
    "tune",
    "verify_published",
]
