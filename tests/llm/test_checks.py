"""Queries of the training-data operators that SQL can express, against that SQL."""

import duckdb
import pytest
from compare import difference

from starloom.llm.checks import CHECKS
from starloom.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_its_check(spark, name):
    tables = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels"):
        tables.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    assert difference(QUERIES[name](spark, SMALL), tables, CHECKS[name]) is None
