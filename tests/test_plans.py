"""Plans stay free of nested-loop joins, Python evaluation and full scans."""

import os
import re

import pytest

import __spark_entry__ as contract
from anchorage.operators import model, splits
from anchorage.plans import registry

FOLDER = "/root/testdata/sf0.001"
FITS = {"lr_grid_search", "single_system_eval", "cross_system_eval"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - FITS))
def test_no_nested_loops_and_no_python(spark, name):
    text = plan(registry.queries()[name](spark, FOLDER))
    for operator in ("NestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert operator not in text


def test_flagship_reads_only_its_columns(spark):
    text = plan(contract.entry(spark))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_shipdate:timestamp_ntz>" in text
    assert "ReadSchema: struct<o_custkey:bigint,o_orderdate:timestamp_ntz>" in text


def test_window_events_shuffle_rows_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(contract.queries()["window_valued_events"](spark, FOLDER))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # events once, the anchor for its aggregate and its join
    assert text.count("Exchange hashpartitioning") == 3 and "SortMergeJoin" in text


def test_class_sizes_need_no_join_on_the_label(spark, tmp_path):
    spark.range(40).selectExpr("id AS subject_id", "CAST(id % 2 AS int) AS label").write.parquet(f"{tmp_path}/s")
    subjects = spark.read.parquet(f"{tmp_path}/s")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (model.with_class_weights(subjects), splits.stratified_folds(subjects)):
            # a join on the label and a chunk is meant, one on the label alone is not
            assert not re.search(r"Join \[label#\d+\],", plan(df))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
