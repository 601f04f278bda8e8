import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from starloom.operators import add_surrogate_key
from starloom.operators.keys import _common_length, _placed
from starloom.session import drop_scratch, new_scratch


def keys_of(df, key="k", out="sk", **options):
    return {r[0]: r[1] for r in add_surrogate_key(df.select(key), key, out, **options).collect()}


@pytest.mark.parametrize("layout", ["dense", "packed"])
def test_keys_do_not_depend_on_shuffle_width_or_row_order(spark, conf, layout):
    ids = spark.range(5000).select(F.sha1(F.col("id").cast("string")).alias("k"))
    first = keys_of(ids, layout=layout)
    conf(spark__sql__shuffle__partitions="13")
    assert keys_of(ids.orderBy(F.rand(3)), layout=layout) == first
    conf(spark__sql__adaptive__enabled="false")
    assert keys_of(ids.repartition(7), layout=layout) == first
    assert len(set(first.values())) == 5000 and min(first.values()) >= 1


def test_dense_keys_are_ranks_across_many_partitions(spark, conf):
    conf(spark__sql__adaptive__enabled="false", spark__sql__shuffle__partitions="9")
    df = spark.range(0, 20000, 2).select((F.col("id") * 7919 % 20011).alias("k"))
    written = add_surrogate_key(df, "k", "sk")
    assert written.rdd.getNumPartitions() > 1
    keys = {r.k: r.sk for r in written.collect()}
    assert keys == {k: i for i, k in enumerate(sorted(keys), 1)}


def test_null_key_takes_the_last_rank(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "k string")
    assert keys_of(df) == {"a": 1, "b": 2, None: 3}


def test_empty_table(spark):
    df = spark.createDataFrame([], "k string")
    assert keys_of(df) == {}
    assert keys_of(df, layout="packed") == {}


def test_packed_key_holds_bucket_and_rank(spark):
    df = spark.range(1000).select(F.col("id").alias("k"))
    packed = add_surrogate_key(df, "k", "sk", layout="packed", buckets=16)
    wrong = packed.where((F.shiftright(F.col("sk") - 1, 33)) != F.pmod(F.hash("k"), F.lit(16)))
    assert wrong.count() == 0
    assert packed.select("sk").distinct().count() == 1000


def test_packed_ranks_need_no_task_of_a_whole_bucket(spark, conf):
    conf(spark__sql__adaptive__coalescePartitions__enabled="false")
    df = spark.range(1000).select(F.col("id").alias("k"))
    packed = add_surrogate_key(df, "k", "sk", layout="packed", buckets=2)
    assert "Window" not in packed._jdf.queryExecution().executedPlan().toString()
    assert packed.select(F.input_file_name()).distinct().count() > 2
    ranks = packed.groupBy(F.shiftright(F.col("sk") - 1, 33).alias("b")).agg(
        F.min("sk").alias("low"), F.max("sk").alias("high"), F.count("*").alias("n")
    )
    assert all(r.low == r.b * 2**33 + 1 and r.high == r.b * 2**33 + r.n for r in ranks.collect())


def long_texts(spark):
    """A third of the keys share 4,000 characters, of these a part 6,000 more; one key is the start of the others."""
    start, more = "a é" * 1333, "\U0001f600b" * 3000
    keys = [f"{i * 7919 % 1009:04d} own start" for i in range(1000)] + [start, start + more, "", None]
    keys += [f"{start}{i * 31 % 499:03d}" for i in range(250)] + [f"{start}{more}{i * 17 % 263}" for i in range(250)]
    return spark.createDataFrame([(k,) for k in keys], "k string").repartition(5)


@pytest.mark.parametrize("layout", ["dense", "packed"])
def test_ranks_of_long_texts(spark, conf, layout):
    conf(spark__sql__shuffle__partitions="16", spark__sql__adaptive__coalescePartitions__enabled="false")
    texts = long_texts(spark)
    keys = keys_of(texts, layout=layout, long_text=True)
    assert keys == keys_of(texts, layout=layout)
    if layout == "dense":
        ordered = sorted((k for k in keys if k is not None), key=str.encode)
        assert keys == {k: i for i, k in enumerate([*ordered, None], 1)}


def test_texts_that_start_alike_are_parted_and_stay_off_the_driver(spark, conf):
    conf(spark__sql__shuffle__partitions="16", spark__sql__adaptive__coalescePartitions__enabled="false")
    texts = long_texts(spark)
    parted = _placed(texts, [], "k", long_text=True)
    sizes = [r["count"] for r in parted.groupBy(F.shiftright("__place", 33)).count().collect()]
    assert max(sizes) < 3 * sum(sizes) / 16, sizes
    # The range shuffle, whose keys the driver samples, sees pieces of the texts alone.
    for placed in (parted, _placed(texts, [], "k", long_text=False)):
        plan = placed._jdf.queryExecution().executedPlan().toString()
        bounds = re.search(r"rangepartitioning\((.*)\), REPARTITION", plan)[1]
        pieces = re.findall(r"substring\(k#\d+, .*?, \d+\)", bounds)
        assert pieces and "k#" not in re.sub(r"substring\(k#\d+", "", bounds), bounds


def test_lengths_shared_by_two_texts(spark):
    pairs = [("", ""), ("abc", "abd"), ("aé", "aé😀"), ("x", "y"), ("q" * 9999 + "a", "q" * 9999 + "b")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(_common_length(F.col("a"), F.col("b"))).collect()] == [0, 2, 2, 0, 9999]


def test_keys_are_bigint_and_come_last(spark):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    for layout in ("dense", "packed"):
        keyed = add_surrogate_key(df, "k", "sk", layout=layout)
        assert keyed.dtypes == [("k", "string"), ("v", "int"), ("sk", "bigint")]
    with pytest.raises(ValueError, match="layout"):
        add_surrogate_key(df, "k", "sk", layout="random")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(keys=st.sets(st.one_of(st.none(), st.integers(-(2**62), 2**62)), min_size=1, max_size=60))
def test_dense_is_row_number_with_nulls_last(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    ordered = sorted(k for k in keys if k is not None) + [None] * (None in keys)
    assert keys_of(df) == {k: i for i, k in enumerate(ordered, 1)}


def test_scratch_is_deleted_only_below_the_shared_folder(spark):
    path = new_scratch(spark)
    add_surrogate_key(spark.range(3), "id", "sk", path=f"{path}/ids").count()
    assert spark.read.parquet(f"{path}/ids").count() == 3
    drop_scratch(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{path}/ids")
    with pytest.raises(ValueError, match="scratch"):
        drop_scratch(spark, "/tmp/elsewhere")
