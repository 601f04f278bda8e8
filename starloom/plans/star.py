"""The whole transform: raw tables in, star out."""

from __future__ import annotations

import threading
from collections.abc import Mapping

from pyspark.sql import DataFrame

from starloom.functions import cast_measures, parse_metrics, parse_purchase_timestamps
from starloom.operators import freeze
from starloom.operators.keys import PACKED_BUCKETS
from starloom.plans import marts
from starloom.plans.dimensions import (
    build_dim_customers,
    build_dim_date,
    build_dim_products,
    build_dim_sellers,
    sold_dates,
)
from starloom.plans.fact import build_fact
from starloom.plans.layout import PART, drop_laid_out, freeze_by_grain
from starloom.plans.quality import quality_checks
from starloom.session import delete_folder, drop_scratch, new_scratch, pinned, side_by_side
from starloom.sources.watch import Watch

DIMENSIONS = ("dim_customers", "dim_products", "dim_sellers", "dim_date")
# Dimensions first, so that a foreign key always finds its member.
STAR_TABLES = (*DIMENSIONS, "fact_order_items")

# Each rollup and the dimensions it reads.
ROLLUPS = {
    "sales_by_month": (marts.sales_by_month, "dim_date"),
    "product_performance": (marts.product_performance, "dim_products"),
    "customer_behavior": (marts.customer_behavior, "dim_customers"),
    "status_mix": (marts.status_mix,),
}


class Star:
    """Four dimensions and a fact that are built on first use.

    A dimension is written below ``scratch`` when it is first asked for, and once:
    its keys cannot change between the fact, the checks and the sinks, also
    when executors are lost. Dimensions asked for together are built side by
    side. The fact is lazy until :meth:`write_fact`.
    """

    def __init__(
        self,
        sources: Mapping[str, DataFrame],
        *,
        layout: str = "dense",
        buckets: int = PACKED_BUCKETS,
        on_error: str = "fail",
        keep_null_date: bool = True,
        scratch: str | None = None,
        watch: Watch | None = None,
    ):
        self.spark = sources["orders"].sparkSession
        self.scratch = scratch or new_scratch(self.spark)
        #: What a run found out while it built the star; None unless a run made it.
        self.report = None
        self._keying = {"layout": layout, "buckets": buckets}
        self._kept: dict[str, DataFrame] = {}
        self._laid_out: DataFrame | None = None
        self._lock = threading.RLock()
        seen = watch or (lambda name, df, **metrics: df)
        with pinned(self.spark):
            self._items = seen("order_items", cast_measures(sources["order_items"], on_error=on_error))
            self._orders = seen(
                "orders",
                parse_purchase_timestamps(sources["orders"]),
                **parse_metrics("order_purchase_timestamp", "order_purchase_ts"),
            )
            self._members = {
                "dim_customers": (build_dim_customers, seen("customers", sources["customers"]), {}),
                "dim_products": (build_dim_products, seen("products", sources["products"]), {}),
                "dim_sellers": (build_dim_sellers, seen("sellers", sources["sellers"]), {}),
                "dim_date": (
                    build_dim_date,
                    sold_dates(self._items, self._orders),
                    {"keep_null_member": keep_null_date},
                ),
            }

    def build(self, *names: str) -> dict[str, DataFrame]:
        """The named dimensions; those not written yet are written now, side by side."""
        with self._lock:
            missing = [name for name in names if name not in self._kept]
            if missing:
                self._kept |= side_by_side(self.spark, {name: lambda name=name: self._written(name) for name in missing})
            return {name: self._kept[name] for name in names}

    def _written(self, name: str) -> DataFrame:
        build, raw, options = self._members[name]
        path = f"{self.scratch}/{name}"
        try:
            return build(raw, path=path, **self._keying, **options)
        except Exception:
            delete_folder(self.spark, path)
            raise

    def fact(self, *dims: str) -> DataFrame:
        """The fact with the keys of the named dimensions alone; no other is built."""
        if set(dims) == set(DIMENSIONS) and "fact_order_items" in self._kept:
            return self._kept["fact_order_items"]
        with pinned(self.spark):
            return build_fact(self._items, self._orders, **self.build(*dims))

    def write_fact(self) -> DataFrame:
        """Write the fact below ``scratch``, once; from then on it is read and not joined again."""
        with self._lock:
            if "fact_order_items" not in self._kept:
                self.keep(fact_order_items=freeze(self.fact_order_items, f"{self.scratch}/fact_order_items"))
            return self._kept["fact_order_items"]

    def lay_out_fact(self, buckets: int | None = None) -> DataFrame:
        """Write the fact below ``scratch`` in buckets by order, once; checks and rollups by order then need no exchange.

        By default as many buckets as a shuffle has partitions. The fact of the
        star has the same columns as before; the layout is kept beside it.
        """
        with self._lock:
            if self._laid_out is None:
                buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
                order_ids = self._items.select("order_id")
                path = f"{self.scratch}/fact_by_grain"
                self._laid_out = freeze_by_grain(self.fact_order_items, order_ids, path, buckets)
                self.keep(fact_order_items=self._laid_out.drop(PART))
            return self._laid_out

    def drop(self) -> None:
        """Delete all that was written below ``scratch``; tables of the star can no longer be read."""
        drop_laid_out(self.spark, self.scratch)
        drop_scratch(self.spark, self.scratch)

    def keep(self, **tables: DataFrame) -> None:
        """Use these written tables from now on."""
        unknown = set(tables) - set(STAR_TABLES)
        if unknown:
            raise ValueError(f"not tables of the star: {sorted(unknown)}")
        self._kept |= tables

    def rollup(self, name: str) -> DataFrame:
        """One of ``ROLLUPS``; only its own dimension is built and read."""
        roll, *dims = ROLLUPS[name]
        if self._laid_out is not None:
            fact = self._laid_out
        else:
            fact = self._kept["fact_order_items"] if "fact_order_items" in self._kept else self.fact(*dims)
        return roll(fact, *self.build(*dims).values())

    @property
    def dim_customers(self) -> DataFrame:
        return self.build("dim_customers")["dim_customers"]

    @property
    def dim_products(self) -> DataFrame:
        return self.build("dim_products")["dim_products"]

    @property
    def dim_sellers(self) -> DataFrame:
        return self.build("dim_sellers")["dim_sellers"]

    @property
    def dim_date(self) -> DataFrame:
        return self.build("dim_date")["dim_date"]

    @property
    def fact_order_items(self) -> DataFrame:
        return self.fact(*DIMENSIONS)

    @property
    def quality_checks(self) -> DataFrame:
        return quality_checks(self.fact_order_items if self._laid_out is None else self._laid_out)

    def tables(self) -> dict[str, DataFrame]:
        """The five tables in publishing order."""
        return {**self.build(*DIMENSIONS), "fact_order_items": self.fact_order_items}


def build_star(sources: Mapping[str, DataFrame], **options) -> Star:
    """The star of the five raw tables, as :class:`Star` with its options. No job is started."""
    return Star(sources, **options)
