"""Every registered query at the smallest scale, against DuckDB where SQL exists."""

import os

import pytest

from harvestlens.plans.catalog import ORACLES, QUERIES
from tests.compare import database, difference, spark_rows, sql_rows

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_equals_sql(spark, con, name):
    got = spark_rows(QUERIES[name](spark, SF_DIR))
    assert difference(got, sql_rows(con, ORACLES[name])) == ""


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
