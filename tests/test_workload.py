"""Every query of the workload against its SQL check, and the driver's contract."""

import pytest
from compare import difference, open_tables
from conftest import SMALL

import __spark_entry__ as contract
from starloom.workload import CHECKS, QUERIES


@pytest.fixture(scope="module")
def tables():
    return open_tables(SMALL)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)
    assert set(QUERIES) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_check(spark, tables, name):
    df = contract.queries()[name](spark, SMALL)
    assert difference(df, tables, contract.oracle_sql()[name]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas", "Scan ExistingRDD"):
        assert operator not in plan


def test_comparison_sees_a_wrong_value(spark, tables):
    df = spark.range(3).withColumnRenamed("id", "n")
    assert difference(df, tables, "SELECT range AS n FROM range(3)") is None
    assert "rows differ" in difference(df, tables, "SELECT range + 1 AS n FROM range(3)")
    assert "rows against" in difference(df, tables, "SELECT range AS n FROM range(4)")
    assert "types" in difference(df, tables, "SELECT range::int AS n FROM range(3)")


def test_entry_builds_the_fact(spark):
    df = contract.entry(spark)
    assert df.count() == 6000 and df.columns[-1] == "DateKey"
