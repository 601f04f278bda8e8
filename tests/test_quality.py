import logging

import pytest

from starloom.plans import build_star, quality_checks, quality_findings
from starloom.plans.quality import QualityError

FACT = (
    "order_id string, order_item_id int, CustomerKey bigint, ProductKey bigint, SellerKey bigint, DateKey bigint"
)


def test_checks_count_nulls_per_key_and_duplicate_groups(spark, sources):
    checks = build_star(sources).quality_checks
    assert checks.columns == ["CustomerKey", "ProductKey", "SellerKey", "DateKey", "duplicates"]
    assert tuple(checks.first()) == (1, 1, 2, 3, 1)
    assert {t for _, t in checks.dtypes} == {"bigint"}


def test_duplicates_are_groups_not_surplus_rows(spark):
    fact = spark.createDataFrame([("a", 1, 1, 1, 1, 1)] * 5 + [("a", 2, 1, 1, 1, 1)] * 2 + [("b", 1, 1, 1, 1, 1)], FACT)
    assert quality_checks(fact).first().duplicates == 2


def test_null_grain_values_form_a_group(spark):
    fact = spark.createDataFrame([(None, 1, 1, 1, 1, 1)] * 2 + [(None, None, 1, 1, 1, 1)], FACT)
    assert quality_checks(fact).first().duplicates == 1


def test_empty_fact_has_zero_findings(spark):
    assert tuple(quality_checks(spark.createDataFrame([], FACT)).first()) == (0, 0, 0, 0, 0)


def test_gate(spark, caplog):
    bad = quality_checks(spark.createDataFrame([("a", 1, None, 1, 1, 1)] * 2, FACT))
    with caplog.at_level(logging.WARNING):
        found = quality_findings(bad)
    assert found == {"CustomerKey": 2, "ProductKey": 0, "SellerKey": 0, "DateKey": 0, "duplicates": 1}
    assert len(caplog.records) == 2
    with pytest.raises(QualityError, match="CustomerKey"):
        quality_findings(bad, gate="fail")
    with pytest.raises(ValueError, match="gate"):
        quality_findings(bad, gate="maybe")
    good = quality_checks(spark.createDataFrame([("a", 1, 1, 1, 1, 1)], FACT))
    assert not any(quality_findings(good, gate="fail").values())
