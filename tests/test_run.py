"""What a run reports, and what it takes to publish it."""

import datetime as dt
import threading
import uuid
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from starloom import run_star
from starloom.operators import freeze
from starloom.plans import build_star
from starloom.plans.quality import repeated_grains
from starloom.plans.star import STAR_TABLES
from starloom.sinks import (
    clean_published,
    export_csv,
    export_text,
    publish_parquet,
    published_versions,
    read_published,
    verify_published,
)
from starloom.sources import SOURCE_SCHEMAS, load_sources, scan_csv, scan_rejects
from starloom.sources.watch import Watch, digest_metrics

LOADED = {"orders": 6, "order_items": 8, "customers": 3, "products": 2, "sellers": 2}
PARSED = {"total_orders": 6, "null_dates": 2, "parse_failures": 1, "null_sources": 1}
FINDINGS = {"CustomerKey": 1, "ProductKey": 1, "SellerKey": 2, "DateKey": 3, "duplicates": 1}


def jobs_of(spark, run):
    """The Spark jobs that ``run`` starts."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setJobGroup("", "")
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_run_reports_what_it_loaded_parsed_and_found(spark, sources, tmp_path):
    star = run_star(spark, sources)
    assert (star.report.loaded, star.report.parsed, star.report.findings) == (LOADED, PARSED, FINDINGS)
    assert star.report.version is None
    star = run_star(spark, sources, str(tmp_path), publish=True)
    assert (star.report.loaded, star.report.parsed, star.report.findings) == (LOADED, PARSED, FINDINGS)
    assert star.report.version == 1


def test_the_report_costs_no_job(spark, sources):
    def plain():
        star = build_star(sources)
        star.keep(fact_order_items=freeze(star.fact_order_items, f"{star.scratch}/fact"))
        return repeated_grains(star.fact_order_items).first()

    plain(), run_star(spark, sources)
    assert jobs_of(spark, plain)[1] == jobs_of(spark, lambda: run_star(spark, sources))[1]


def test_a_run_over_empty_tables_reports_zeros(spark, sources):
    star = run_star(spark, {name: df.limit(0) for name, df in sources.items()})
    assert set(star.report.loaded.values()) | set(star.report.findings.values()) == {0}
    items_only = run_star(spark, {**sources, "order_items": sources["order_items"].limit(0)})
    assert items_only.report.loaded == {**LOADED, "order_items": 0} and items_only.report.parsed == PARSED


def test_types_are_inferred_through_the_run(spark, sources, tmp_path):
    for name, df in sources.items():
        export_csv(df, f"{tmp_path}/{name}.csv")
    star = run_star(spark, str(tmp_path), infer_schema=True)
    assert star.report.loaded == LOADED
    assert dict(star.dim_sellers.dtypes)["seller_zip_code_prefix"] == "int"


def test_after_a_publish_the_star_reads_the_published_tables(spark, sources, tmp_path):
    star = run_star(spark, sources, str(tmp_path), publish=True)
    for name, table in star.tables().items():
        assert all(f"{tmp_path}/runs/" in file for file in table.inputFiles()), name
    assert "Join" not in star.quality_checks._jdf.queryExecution().executedPlan().toString()


def test_a_watch_counts_again_what_was_not_read(spark):
    watch = Watch()
    seen = watch("one", spark.range(5), least=F.min("id"))
    seen.where("id > 2").collect()
    assert watch.result("one") == {"rows": 5, "least": 0}
    with pytest.raises(ValueError, match="watched already"):
        watch("one", spark.range(1))
    lost = watch("lost", spark.range(7))
    spark.range(3).where("id < 0").join(lost, "id").collect()
    assert watch.result("lost") == {"rows": 7}


def digest(df):
    return df.agg(digest_metrics(df)["digest"]).first()[0]


def test_a_digest_tells_tables_apart_but_not_their_order(spark):
    schema = "a string, b string"
    one = spark.createDataFrame([("x", None), ("y", "z")], schema)
    assert digest(one) == digest(one.orderBy(F.desc("a")).repartition(3))
    for other in ([(None, "x"), ("y", "z")], [("x", None)], [("x", None), ("y", "z"), ("y", "z")], [("x", ""), ("y", "z")]):
        assert digest(spark.createDataFrame(other, schema)) != digest(one)
    assert digest(one.limit(0)) == "0"


# --- the lazy star -----------------------------------------------------------


def test_a_star_is_built_without_a_job(spark, sources):
    star, jobs = jobs_of(spark, lambda: build_star(sources))
    assert jobs == 0
    fact, jobs = jobs_of(spark, lambda: star.rollup("status_mix"))
    assert jobs == 0 and "Key" not in fact._jdf.queryExecution().optimizedPlan().toString()
    assert not star._kept


def test_each_dimension_is_written_once(spark, sources):
    star = build_star(sources)
    with ThreadPoolExecutor(4) as pool:
        dims = list(pool.map(lambda _: star.build("dim_sellers")["dim_sellers"], range(4)))
    assert len({id(d) for d in dims}) == 1 and set(star._kept) == {"dim_sellers"}
    assert star.fact("dim_sellers").columns[-1] == "SellerKey" and set(star._kept) == {"dim_sellers"}
    fact = star.write_fact()
    assert star.write_fact() is fact and star.fact_order_items is fact
    assert star.rollup("customer_behavior").count() == 3
    with pytest.raises(ValueError, match="not tables"):
        star.keep(dim_colours=fact)


def test_a_failed_dimension_can_be_built_again(spark, sources):
    star = build_star(sources)
    build, raw, options = star._members["dim_sellers"]
    broken = raw.withColumn("seller_city", F.when(F.length("seller_id") > 0, F.raise_error(F.lit("broken"))).cast("string"))
    star._members["dim_sellers"] = (build, broken, options)
    with pytest.raises(Exception, match="broken"):
        star.dim_sellers  # noqa: B018
    star._members["dim_sellers"] = (build, raw, options)
    assert star.dim_sellers.count() == 2


def test_dates_do_not_depend_on_the_callers_zone(spark, conf, sources):
    expected = sorted(map(repr, build_star(sources).dim_date.collect()))
    for zone in ("Asia/Tokyo", "America/Los_Angeles"):
        conf(spark__sql__session__timeZone=zone)
        star = build_star(sources)
        # 2018-01-01 0:30 in Tokyo is still 2017 by the engine's clock.
        stamped = sources["orders"].withColumn("order_purchase_timestamp", F.lit(dt.datetime(2018, 1, 1, 5)))
        conf(spark__sql__session__timeZone="UTC")
        assert sorted(map(repr, star.dim_date.collect())) == expected
        dates = build_star({**sources, "orders": stamped}).dim_date
        assert [str(r.Date) for r in dates.collect()] == ["2018-01-01"]


# --- publishers --------------------------------------------------------------


def test_two_publishers_at_once_make_two_versions(spark, sources, tmp_path):
    target = f"{tmp_path}/dwh"
    tables = build_star(sources).tables()
    fewer = build_star({**sources, "order_items": sources["order_items"].where("order_id = 'o1'")}).tables()
    start = threading.Barrier(3)

    def publish(what):
        start.wait()
        return publish_parquet(what, target)

    with ThreadPoolExecutor(3) as pool:
        versions = list(pool.map(publish, (tables, fewer, tables)))
    assert sorted(versions) == [1, 2, 3]
    listed = published_versions(spark, target).collect()
    assert sorted(r.version for r in listed) == [1, 2, 3] and len({r.run for r in listed}) == 3
    assert all([t.name for t in r.tables] == list(STAR_TABLES) for r in listed)


def test_a_number_taken_but_not_filled_is_skipped(spark, sources, tmp_path):
    tables = build_star(sources).tables()
    (tmp_path / "versions").mkdir()
    (tmp_path / "versions" / "000000000001.json").touch()
    assert publish_parquet(tables, str(tmp_path)) == 2
    assert published_versions(spark, str(tmp_path)).count() == 1


def test_runs_without_a_version_are_cleaned_after_a_while(spark, sources, tmp_path):
    target = str(tmp_path / "dwh")
    assert clean_published(spark, target) == []
    publish_parquet(build_star(sources).tables(), target)
    lost = tmp_path / "dwh" / "runs" / "lost" / "dim_date"
    lost.mkdir(parents=True)
    assert clean_published(spark, target) == []
    assert clean_published(spark, target, older_than=0) == ["lost"]
    assert read_published(spark, target)["fact_order_items"].count() == 7


def test_damage_to_published_files_shows(spark, sources, tmp_path):
    target = str(tmp_path / "dwh")
    with pytest.raises(ValueError, match="nothing"):
        verify_published(spark, target)
    publish_parquet(build_star(sources).tables(), target)
    assert all(r.intact for r in verify_published(spark, target).collect())
    run = published_versions(spark, target).first().run
    spark.createDataFrame([("sX", "1", "X", "Y", 9)], read_published(spark, target)["dim_sellers"].schema).write.mode(
        "append"
    ).parquet(f"{target}/runs/{run}/dim_sellers")
    assert {r.name for r in verify_published(spark, target).collect() if not r.intact} == {"dim_sellers"}


# --- files -------------------------------------------------------------------

# The first lines of the published exports.
EXPORTED_SELLERS = """"seller_id","seller_zip_code_prefix","seller_city","seller_state","SellerKey"
"062ce95fa2ad4dfaedfc79260130565f",95913,"LAJEADO","RS","1"
"""
EXPORTED_DATES = """"Date","Year","Month","Day","Weekday","Quarter","DateKey"
"2017-08-11",2017,8,11,6,3,"1"
"""


def exported(df, path):
    export_text(df.coalesce(1), str(path))
    files = [p for p in path.iterdir() if p.name.startswith("part-") and p.stat().st_size]
    return "".join(p.read_bytes().decode() for p in files)


def test_text_export_has_the_published_bytes(spark, tmp_path):
    sellers = spark.createDataFrame(
        [("062ce95fa2ad4dfaedfc79260130565f", 95913, "LAJEADO", "RS", 1)],
        "seller_id string, seller_zip_code_prefix int, seller_city string, seller_state string, SellerKey bigint",
    )
    assert exported(sellers, tmp_path / "s") == EXPORTED_SELLERS
    dates = spark.createDataFrame(
        [(dt.date(2017, 8, 11), 2017, 8, 11, 6, 3, 1)],
        "Date date, Year int, Month int, Day int, Weekday int, Quarter int, DateKey bigint",
    )
    assert exported(dates, tmp_path / "d") == EXPORTED_DATES
    assert exported(dates.limit(0), tmp_path / "e") == EXPORTED_DATES.split("\n")[0] + "\n"


def test_text_export_quotes_by_column_and_reads_back(spark, tmp_path):
    rows = [('say "x", y', None, 1.5, None), ("", "é\n2", None, 7), (None, " z ", 2.0, 8)]
    df = spark.createDataFrame(rows, "a string, `b c` string, d double, e bigint")
    text = exported(df, tmp_path / "t")
    assert text == '"a","b c","d","e"\n"say ""x"", y",,1.5,\n"","é\n2",,"7"\n," z ",2.0,"8"\n'
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema(df.schema)
    back = reader.option("emptyValue", "").option("nullValue", None).csv(str(tmp_path / "t"))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    # Every file has the header, so a folder of several reads like one table.
    many = spark.range(100).select("id", F.col("id").cast("string").alias("s")).repartition(4)
    export_text(many, f"{tmp_path}/many")
    assert scan_csv(spark, f"{tmp_path}/many", many.schema).count() == 100


HEADER = "order_id,order_item_id,product_id,seller_id,price,freight_value\n"


def test_a_bad_value_in_an_unread_column_fails_the_load(spark, tmp_path, sources):
    for name, df in sources.items():
        export_csv(df, f"{tmp_path}/{name}.csv")
    (tmp_path / "bad.csv").write_text(HEADER + "o1,1,p1,s1,1.0,2.0\no2,one,p1,s1,1.0,2.0\n")
    items = SOURCE_SCHEMAS["order_items"]
    assert scan_csv(spark, str(tmp_path / "bad.csv"), items).select("order_id").count() == 2
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        scan_csv(spark, str(tmp_path / "bad.csv"), items, whole_rows=True).select("order_id").collect()
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        scan_csv(spark, str(tmp_path / "bad.csv"), items, whole_rows=True).count()
    (tmp_path / "order_items.csv").rename(tmp_path / "good.csv")
    (tmp_path / "bad.csv").rename(tmp_path / "order_items.csv")
    loaded = load_sources(spark, str(tmp_path))
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        loaded["order_items"].select("order_id").collect()


def test_rejects_are_counted_by_file(spark, tmp_path):
    folder = tmp_path / "items"
    folder.mkdir()
    (folder / "a.csv").write_text(HEADER + "o1,1,p1,s1,1.0,2.0\no2,one,p1,s1,x,2.0\no3,,p1,s1,,\n")
    (folder / "b.csv").write_text(HEADER + "o1,1.5,p1,s1,1.0,2.0\no2,9999999999,p1,s1,x,2.0\n")
    found = scan_rejects(spark, str(folder), SOURCE_SCHEMAS["order_items"]).collect()
    assert {r.file.rsplit("/")[-1]: (r.rows, r.rejects) for r in found} == {"a.csv": (3, 1), "b.csv": (2, 2)}
