"""Every registered query equals its SQL on whole tables, and does not depend on partitioning."""

import re

import pytest

import __spark_entry__ as entry
from conftest import SF
from rasterloom.checks.harness import run_sql, same

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert same(got, run_sql(ORACLES[name], SF)) == ""


def test_raster_queries_have_sql():
    """Only training-data queries may have none."""
    assert all(re.match(r"op\d+_|pipeline$", name) for name in QUERIES.keys() - ORACLES.keys())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
