"""Time the queries, and the star build against a plainer one.

Prints one JSON line. Settings come from the environment: BENCH_SF_DIR,
BENCH_CPUS, BENCH_MEMORY, BENCH_RUNS (timed runs after one warm-up; the median
counts) and BENCH_QUERIES (names, comma-separated; ``all`` by default).
"""

from __future__ import annotations

import json
import os
import statistics
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions import cast_measures, parse_purchase_timestamps
from starloom.operators import dedup_natural_key, duplicate_groups, lookup_key
from starloom.plans import build_fact_base, build_star
from starloom.plans.fact import FACT_COLUMNS
from starloom.plans.quality import FOREIGN_KEYS, GRAIN
from starloom.session import local_session, new_scratch
from starloom.sinks import publish_parquet
from starloom.sources.bench_tables import raw_tables
from starloom.workload import QUERIES

HEADLINE = "fact_order_items"


def consume(df: DataFrame) -> None:
    """Compute every row and column, and keep none."""
    df.write.format("noop").mode("overwrite").save()


def star_published(spark: SparkSession, sf_dir: str) -> None:
    """Raw tables in, checked star tables out."""
    publish_parquet(build_star(raw_tables(spark, sf_dir)).tables(), new_scratch(spark))


def star_step_by_step(spark: SparkSession, sf_dir: str) -> None:
    """The same with an action after each step and cached numberings."""
    raw = raw_tables(spark, sf_dir)
    for table in raw.values():
        table.count()
    orders = parse_purchase_timestamps(raw["orders"])
    orders.count()
    orders.where("order_purchase_ts IS NULL").count()
    fact = build_fact_base(cast_measures(raw["order_items"]), orders).withColumn("Date", F.to_date("order_purchase_ts"))
    done = []
    for key, out, members in (
        ("customer_id", "CustomerKey", raw["customers"]),
        ("product_id", "ProductKey", raw["products"]),
        ("seller_id", "SellerKey", raw["sellers"]),
        ("Date", "DateKey", None),
    ):
        members = fact.select("Date").distinct() if members is None else dedup_natural_key(members, key)
        dim = members.withColumn(out, F.monotonically_increasing_id() + 1).cache()
        dim.count()
        done.append(dim)
        fact = lookup_key(fact, dim, key, out)
    fact = fact.select(*FACT_COLUMNS).cache()
    fact.count()
    done.append(fact)
    for out in FOREIGN_KEYS:
        fact.where(F.col(out).isNull()).count()
    duplicate_groups(fact, *GRAIN).count()
    target = new_scratch(spark)
    for n, df in enumerate(done):
        df.write.parquet(f"{target}/{n}")
        df.unpersist()


def timed(spark: SparkSession, run: Callable[[], None], runs: int) -> tuple[float, int]:
    """Median seconds, and the Spark jobs of one run."""
    seconds, jobs = [], 0
    for attempt in range(runs + 1):
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, group)
        start = time.perf_counter()
        run()
        if attempt:
            seconds.append(time.perf_counter() - start)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    return round(statistics.median(seconds), 3), jobs


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    wanted = os.environ.get("BENCH_QUERIES", "all")
    chosen = list(QUERIES) if wanted == "all" else wanted.split(",")
    conf = {
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "7g"),
        "spark.ui.showConsoleProgress": "false",
    }
    spark = local_session(cpus, cpus, **conf)
    spark.sparkContext.setLogLevel("OFF")

    seconds, jobs = {}, {}
    for name in chosen:
        seconds[name], jobs[name] = timed(spark, lambda name=name: consume(QUERIES[name](spark, sf_dir)), runs)
    builds = {}
    for build in (star_published, star_step_by_step):
        builds[build.__name__], jobs[build.__name__] = timed(spark, lambda build=build: build(spark, sf_dir), runs)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": f"{HEADLINE}_wall_time",
                "value": seconds.get(HEADLINE, next(iter(seconds.values()))),
                "unit": "sec",
                "queries": seconds,
                "builds": builds,
                "jobs": jobs,
                "total": round(sum(seconds.values()), 3),
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": cpus,
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
