"""Every registered query against its SQL, and plans that must not break at scale."""

import pytest

import __spark_entry__ as entry_points
from terraload.checks.catalog import ORACLES, QUERIES
from terraload.checks.runner import compare

SF_DIR = "/root/testdata/sf0.001"


def test_contract(spark):
    assert set(ORACLES) <= set(QUERIES) <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())
    assert entry_points.entry(spark).count() == 5


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    ok, note = compare(spark, SF_DIR, QUERIES[name], ORACLES.get(name))
    assert ok, note


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"ingest_to_model", "build_manifest"}))
def test_plan_has_no_cross_join_and_no_single_task_window(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Window ["):
        assert bad not in plan, name
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


def test_reading_what_uploads_leave_takes_no_task_for_each_few_files(spark):
    name, before = "spark.sql.files.openCostInBytes", spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set(name, spark.conf.get("spark.sql.files.maxPartitionBytes"))
    try:
        left = QUERIES["delete_upload_files"](spark, SF_DIR)
        assert left.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) < left.count()
    finally:
        spark.conf.set(name, before)


def test_files_that_uploads_leave_are_not_listed_on_the_driver(spark):
    assert QUERIES["delete_uploads_owned_twice"](spark, SF_DIR).inputFiles() == []
