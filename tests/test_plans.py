"""Physical plans that must hold at any scale, checked without broadcasts."""

import os

import pytest

from harvestlens.plans.catalog import QUERIES
from tests.compare import explained

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")

# These run jobs while they build (training, streams, stored steps) and end in a plain read.
EAGER = {
    "surrogate_predict", "surrogate_quality", "surrogate_boosted", "surrogate_stored", "feature_importance",
    "impact_clusters", "status_stream", "status_batches", "top_features", "prediction_file", "resumed_runs", "run_set_up",
    *(n for n in QUERIES if QUERIES[n].__module__.endswith("source_queries")),
}
PYTHON = {"parallel_apply", "retried_runs"}


@pytest.fixture(autouse=True)
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_only_equi_joins_and_no_python(spark, name):
    plan = explained(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert name in PYTHON or not any(p in plan for p in ("InPandas", "PythonUDF", "ArrowEval", "BatchEval"))


@pytest.mark.parametrize("name", ["impacts_all_periods", "region_mean", "adaptation_rank"])
def test_results_scan_reads_only_needed_columns(spark, name):
    plan = explained(QUERIES[name](spark, SF_DIR))
    schemas = [line for line in plan.splitlines() if "ReadSchema" in line and "l_quantity" in line]
    assert schemas and all("l_tax" not in s and "l_shipdate" not in s for s in schemas)
    assert any("o_orderdate" in line for line in plan.splitlines() if "PushedFilters" in line)


@pytest.mark.parametrize("name", ["standardize_long", "adaptation_settings", "period_assignment", "period_assignment_table"])
def test_configured_lists_are_no_driver_tables(spark, name):
    assert "ExistingRDD" not in explained(QUERIES[name](spark, SF_DIR))


def _operators(plan):
    """Names in the tree at the top of a formatted plan."""
    return [line.strip(" :+-*|").split(" (")[0] for line in plan.split("\n\n")[0].splitlines()]


def test_standard_names_need_one_shuffle(spark):
    names = _operators(explained(QUERIES["standardize_long"](spark, SF_DIR)))
    assert names.count("Exchange") == 1 and not any("Join" in n for n in names)


def test_work_is_split_in_two_scans(spark):
    """The rows and their bucket counts; the total comes with the counts."""
    names = _operators(explained(QUERIES["work_split"](spark, SF_DIR)))
    assert sum(n.startswith("Scan parquet") for n in names) <= 2
