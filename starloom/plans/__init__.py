"""The star build: dimensions, fact, checks and rollups."""

from starloom.plans.dimensions import build_dim_customers, build_dim_date, build_dim_products, build_dim_sellers
from starloom.plans.fact import build_fact, build_fact_base
from starloom.plans.quality import quality_checks, quality_findings
from starloom.plans.star import Star, build_star

__all__ = [
    "Star",
    "build_dim_customers",
    "build_dim_date",
    "build_dim_products",
    "build_dim_sellers",
    "build_fact",
    "build_fact_base",
    "build_star",
    "quality_checks",
    "quality_findings",
]
