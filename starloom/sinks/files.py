"""Full refresh to Parquet, and CSV export."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.operators import freeze
from starloom.plans.quality import null_metrics, quality_findings, repeated_grains
from starloom.plans.star import STAR_TABLES
from starloom.session import delete_folder, side_by_side
from starloom.sources.watch import Watch, digest_metrics

VERSION_SCHEMA = "version bigint, run string, tables array<struct<name: string, rows: bigint, digest: string>>"
# A run folder without a version may belong to a publisher that is still at work for so long.
GRACE_SECONDS = 24 * 3600
# Local file systems look and then create; within one driver this makes it one step.
_listing = threading.Lock()


@dataclass(frozen=True)
class Published:
    """One publish: what was listed, and what the checks found in the fact."""

    version: int
    run: str
    findings: dict[str, int]
    tables: dict[str, dict]


def published_versions(spark: SparkSession, target: str) -> DataFrame:
    """The versions published so far: (version, run, tables), with rows and digest of each table."""
    return spark.read.schema(VERSION_SCHEMA).json(f"{target}/versions").where("version is not null")


def publish_parquet(tables: Mapping[str, DataFrame], target: str, gate: str = "warn") -> int:
    """Write the star as a new version of ``target`` and make it current; returns the version."""
    return publish_version(tables, target, gate).version


def publish_version(tables: Mapping[str, DataFrame], target: str, gate: str = "warn") -> Published:
    """Write the star as a new version of ``target`` and make it current.

    Dimensions are written first and the fact last, into a folder of their
    own. A digest of each table and the NULLs of the fact's keys are taken while
    the rows are written; only the grain of the written fact is read again. Then
    the version is listed, by one small file: readers see the old star or the
    new one, never a mix, and a run that fails or is stopped by the gate leaves
    nothing behind.

    Several publishers may work at once. Each has a run folder of its own, and
    a version number belongs to the one that creates its file, which Hadoop's
    file system allows once; the others take the next number. On a file
    system that cannot create a file only if it is absent, such as some object
    stores, publish from one driver at a time.
    """
    spark = tables["fact_order_items"].sparkSession
    run = uuid.uuid4().hex
    paths = {name: _table_path(target, run, name) for name in STAR_TABLES}
    *dims, fact = STAR_TABLES
    watch = Watch()
    watched = {
        name: watch(name, tables[name], **digest_metrics(tables[name]), **(null_metrics() if name == fact else {}))
        for name in STAR_TABLES
    }
    try:
        side_by_side(spark, {name: lambda name=name: watched[name].write.parquet(paths[name]) for name in dims})
        written = freeze(watched[fact], paths[fact])
        seen = {name: watch.result(name) for name in STAR_TABLES}
        findings = {key: seen[fact].pop(key) for key in null_metrics()} | repeated_grains(written).first().asDict()
        quality_findings(findings, gate)
        version = _list_version(spark, target, run, seen)
    except Exception:
        delete_folder(spark, f"{target}/runs/{run}")
        raise
    return Published(version, run, findings, seen)


def _table_path(target: str, run: str, name: str) -> str:
    return f"{target}/runs/{run}/{name}"


def _list_version(spark: SparkSession, target: str, run: str, seen: Mapping[str, dict]) -> int:
    """Take the first free version number after the latest, and write its file."""
    version = _latest(spark, target)[0]
    while True:
        version += 1
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/versions/{version:012d}.json")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        try:
            with _listing:
                out = files.create(path, False)
        except Py4JJavaError as error:
            if not files.exists(path) or "FileAlreadyExistsException" not in error.java_exception.toString():
                raise
            continue
        entry = {"version": version, "run": run, "tables": [{"name": name, **found} for name, found in seen.items()]}
        try:
            out.write(bytearray(json.dumps(entry).encode()))
            out.close()
        except Exception:
            files.delete(path, False)
            raise
        return version


def read_version(spark: SparkSession, target: str, run: str) -> dict[str, DataFrame]:
    """The tables of one run."""
    return {name: spark.read.parquet(_table_path(target, run, name)) for name in STAR_TABLES}


def read_published(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    """The tables of the version published last."""
    version, run = _latest(spark, target)
    if not version:
        raise ValueError(f"nothing is published at {target}")
    return read_version(spark, target, run)


def verify_published(spark: SparkSession, target: str) -> DataFrame:
    """(name, rows, intact) for each table of the version published last.

    Each table is read whole, and its rows and digest held against those that
    were taken when it was written: files that were lost, doubled or changed show.
    """
    version, run = _latest(spark, target)
    if not version:
        raise ValueError(f"nothing is published at {target}")
    listed = published_versions(spark, target).where((F.col("version") == version) & (F.col("run") == run)).first()
    checks = []
    for entry in listed.tables:
        table = spark.read.parquet(_table_path(target, run, entry.name))
        now = table.agg(F.count("*").alias("rows"), digest_metrics(table)["digest"].alias("digest"))
        same = (F.col("rows") == entry.rows) & (F.col("digest") == entry.digest)
        checks.append(now.select(F.lit(entry.name).alias("name"), "rows", same.alias("intact")))
    return reduce(DataFrame.unionAll, checks)


def expire_published(spark: SparkSession, target: str, keep: int = 2) -> int:
    """Delete the files of all but the last ``keep`` versions; returns how many went now.

    Keep more than one while readers may still be on an older version.
    """
    if keep < 1:
        raise ValueError("the current version cannot be expired")
    last = _latest(spark, target)[0]
    old = published_versions(spark, target).where(F.col("version") <= last - keep).collect()
    return sum(delete_folder(spark, f"{target}/runs/{version.run}") for version in old)


def clean_published(spark: SparkSession, target: str, older_than: float = GRACE_SECONDS) -> list[str]:
    """Delete the runs that no version names, left by drivers that were lost; returns their names.

    Runs changed within the last ``older_than`` seconds stay: their publisher may still be at work.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/runs")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    # One name per run of the past.
    runs = {status.getPath().getName(): _last_change(files, status) for status in files.listStatus(folder)}
    try:
        named = {row.run for row in published_versions(spark, target).select("run").collect()}
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        named = set()
    before = (time.time() - older_than) * 1000
    lost = sorted(run for run, changed in runs.items() if run not in named and changed <= before)
    return [run for run in lost if delete_folder(spark, f"{target}/runs/{run}")]


def _last_change(files, status) -> int:
    """When a run folder or a table folder in it last changed, in milliseconds."""
    tables = files.listStatus(status.getPath()) if status.isDirectory() else []
    return max([status.getModificationTime(), *[table.getModificationTime() for table in tables]])


def _latest(spark: SparkSession, target: str) -> tuple[int, str | None]:
    try:
        versions = published_versions(spark, target)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, None
    last = versions.select("version", "run").orderBy("version", "run", ascending=False).first()
    return (last.version, last.run) if last else (0, None)


def export_csv(df: DataFrame, path: str) -> None:
    """Write a table as CSV text with a header row.

    Outer spaces are kept. An empty string reads back as NULL, and a value
    with a line break needs a reader that allows records of several lines.
    """
    keep_spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.option("header", True).option("escape", '"').options(**keep_spaces).csv(path)


def export_text(df: DataFrame, path: str, unquoted: Sequence[str] | None = None) -> None:
    """Write a table in the warehouse's export format: one line a row, quotes by column.

    Names, texts, dates and keys are quoted, ``unquoted`` columns are not: by
    default those of type int, short, byte, float, double, decimal and boolean.
    (A surrogate key is a bigint.) A NULL is nothing between two commas, an empty text a pair
    of quotes; quotes within a value are doubled. Each file has the header.
    """
    plain = ("int", "smallint", "tinyint", "float", "double", "boolean")
    if unquoted is None:
        unquoted = [name for name, kind in df.dtypes if kind in plain or kind.startswith("decimal")]
    header = ",".join(_quoted_name(name) for name in df.columns)
    line = F.concat_ws(",", *[F.coalesce(_field(name, name in unquoted), F.lit("")) for name in df.columns])
    # Row ids start again at each partition, which becomes one file.
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    watch = Watch()
    rows = watch("rows", df).select(F.when(first, F.concat(F.lit(header + "\n"), line)).otherwise(line).alias("value"))
    rows.write.text(path)
    if not watch.result("rows")["rows"]:
        df.sparkSession.range(1).select(F.lit(header).alias("value")).write.mode("append").text(path)


def _quoted_name(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _field(name: str, plain: bool) -> Column:
    text = F.col(f"`{name}`").cast("string")
    return text if plain else F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
