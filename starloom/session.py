"""Session settings the engine relies on, and the place for frozen tables."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    # Dates are cut from timestamps in the session zone, so the zone is pinned.
    "spark.sql.session.timeZone": "UTC",
    # A malformed measure raises unless the caller asks for NULL.
    "spark.sql.ansi.enabled": "true",
    "spark.sql.legacy.timeParserPolicy": "CORRECTED",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where the split costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Hash instead of sort where every partition of one side proved this small.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # Keys the driver sees per range partition when dense keys are placed.
    "spark.sql.execution.rangeExchange.sampleSizePerPartition": "20",
}

# 13.4 MB of raw orders and items became 32 MiB of rows in a shuffle at sf0.1,
# so this many file bytes make about 300 MB of rows in a partition.
SOURCE_BYTES_PER_PARTITION = 128 * 1024 * 1024
# Spark gives an input of unknown size the largest long.
UNKNOWN_SIZE = 1 << 62


def tune(spark: SparkSession) -> SparkSession:
    """Apply the engine's runtime SQL settings to a session."""
    for name, value in SESSION_CONF.items():
        spark.conf.set(name, value)
    return spark


# What expressions take from the session when they are analysed.
ANALYSIS_CONF = ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.legacy.timeParserPolicy")


@contextmanager
def pinned(spark: SparkSession) -> Iterator[None]:
    """Columns made inside take the engine's zone and strictness; the session's own settings come back.

    Spark fixes both when a plan is analysed, so dates do not depend on the
    caller's zone, also if the plan runs later.
    """
    before = {name: spark.conf.get(name, None) for name in ANALYSIS_CONF}
    for name in ANALYSIS_CONF:
        spark.conf.set(name, SESSION_CONF[name])
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("starloom")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for name, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def source_bytes(df: DataFrame) -> int:
    """Bytes of the files below a plan, as the optimizer knows them.

    Inputs of unknown size, such as rows from the driver, count as nothing.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(size for size in sizes if size < UNKNOWN_SIZE)


def widen_shuffle(spark: SparkSession, sources: dict[str, DataFrame]) -> int:
    """Raise the shuffle width to suit the size of the sources.

    It is never lowered: AQE merges partitions that turn out small.
    """
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    needed = math.ceil(sum(map(source_bytes, sources.values())) / SOURCE_BYTES_PER_PARTITION)
    wider = max(width, needed)
    if wider > width:
        spark.conf.set("spark.sql.shuffle.partitions", str(wider))
    return wider


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="starloom-"))
    return context.getCheckpointDir().rstrip("/")


def new_scratch(spark: SparkSession) -> str:
    """A fresh, unused path below the shared folder."""
    return f"{shared_dir(spark)}/starloom/{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete one scratch path made by :func:`new_scratch`."""
    if "/starloom/" not in path:
        raise ValueError(f"not a scratch path: {path}")
    delete_folder(spark, path)


def delete_folder(spark: SparkSession, path: str) -> bool:
    """Delete a folder if it is there; whether it was."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True))


def side_by_side(spark: SparkSession, jobs: dict[str, Callable]) -> dict:
    """Run jobs that do not depend on one another at the same time.

    Small jobs leave most of a cluster idle; together they fill it.
    """
    with ThreadPoolExecutor(len(jobs)) as pool:
        started = {name: pool.submit(inheritable_thread_target(spark)(job)) for name, job in jobs.items()}
        return {name: future.result() for name, future in started.items()}
