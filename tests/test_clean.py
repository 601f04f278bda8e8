import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from starloom.functions import (
    calendar_parts,
    cast_measures,
    normalize_text,
    parse_check,
    parse_timestamp,
    zip_prefix,
)


@pytest.mark.parametrize(
    ("text", "minute"),
    [
        ("8/11/2017 9:05", dt.datetime(2017, 8, 11, 9, 5)),
        ("08/11/2017 09:05", dt.datetime(2017, 8, 11, 9, 5)),
        ("1/1/2018 0:00", dt.datetime(2018, 1, 1)),
        ("13/1/2017 9:05", None),
        ("8/11/2017 9:05:10", None),
        ("2017-08-11 09:05:10", None),
        ("8/11/17 9:05", None),
        ("2/30/2018 1:00", None),
        ("8/11/2017 24:00", None),
        (" 8/11/2017 9:05", None),
        ("", None),
        (None, None),
    ],
)
def test_purchase_time_is_parsed_or_null(spark, text, minute):
    df = spark.createDataFrame([(text,)], "raw string")
    parsed = parse_timestamp(df, "raw", "ts").select(F.col("ts").cast("timestamp_ntz"))
    assert parsed.first()[0] == minute


def test_a_timestamp_passes_through_with_its_seconds(spark):
    df = spark.sql("SELECT timestamp '2017-08-11 09:05:10' AS raw")
    parsed = parse_timestamp(df, "raw", "ts").select(F.col("ts").cast("timestamp_ntz"))
    assert parsed.first()[0] == dt.datetime(2017, 8, 11, 9, 5, 10)


def test_the_first_format_that_fits_wins(spark):
    df = spark.createDataFrame([("2017-08-11 09:05:10",), ("8/11/2017 9:05",), ("x",)], "raw string")
    formats = ("M/d/yyyy H:mm", "yyyy-MM-dd HH:mm:ss")
    parsed = parse_timestamp(df, "raw", "ts", formats).select(F.col("ts").cast("timestamp_ntz"))
    assert [r[0] for r in parsed.collect()] == [
        dt.datetime(2017, 8, 11, 9, 5, 10),
        dt.datetime(2017, 8, 11, 9, 5),
        None,
    ]


def test_parse_check_tells_failures_from_empty_sources(spark):
    df = spark.createDataFrame([("8/11/2017 9:05",), ("x",), (None,), ("y",)], "raw string")
    checks = parse_check(parse_timestamp(df, "raw", "ts"), "raw", "ts").first()
    assert tuple(checks) == (4, 3, 2, 1)


def test_malformed_measures_fail_or_become_null(spark):
    df = spark.createDataFrame([("1.5", "2"), ("abc", None)], "price string, freight_value string")
    assert [tuple(r) for r in cast_measures(df, on_error="null").collect()] == [(1.5, 2.0), (None, None)]
    with pytest.raises(PySparkException, match="CAST_INVALID_INPUT"):
        cast_measures(df).collect()
    with pytest.raises(ValueError, match="on_error"):
        cast_measures(df, on_error="skip")


def test_malformed_measures_fail_without_ansi_too(spark, conf):
    df = spark.createDataFrame([("1.5", "2"), ("abc", None)], "price string, freight_value string")
    conf(spark__sql__ansi__enabled="false")
    with pytest.raises(PySparkException, match="CAST_INVALID_INPUT"):
        cast_measures(df).collect()


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("  são\t ", "SÃO\t"),
        ("sao  paulo", "SAO  PAULO"),
        (" rio ", " RIO"),
        ("   ", ""),
        (None, None),
    ],
)
def test_text_is_upper_case_without_outer_spaces(spark, text, clean):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(normalize_text("t")).first()[0] == clean


def test_zip_prefix_styles(spark):
    df = spark.createDataFrame([("04123",), ("4123",)], "zip string")
    styles = df.select(*[zip_prefix("zip", s) for s in ("text", "padded", "int")])
    assert [tuple(r) for r in styles.collect()] == [("04123", "04123", 4123), ("4123", "04123", 4123)]
    with pytest.raises(ValueError, match="style"):
        zip_prefix("zip", "hex")


def test_weekday_counts_from_sunday(spark):
    df = spark.sql("SELECT explode(array(date '2017-02-26', date '2017-08-11')) AS d")
    assert [tuple(r) for r in df.select(*calendar_parts("d")).collect()] == [
        (2017, 2, 26, 1, 1),
        (2017, 8, 11, 6, 3),
    ]
