"""Shape of the plans and rules on the source text."""

import re
from pathlib import Path

import pytest

from conftest import SF
from __spark_entry__ import queries
from taskspan.llm import decontaminate

PACKAGE = Path(__file__).resolve().parents[1] / "taskspan"
PLANNED = ["extract_tasks", "trim_bottom", "threshold_outliers", "prepare_test", "business_dates",
           "rework_merge", "config_stats_named", "quantile_lookup", "prepare_train"]


@pytest.mark.parametrize("name", PLANNED)
def test_plan_stays_in_the_jvm_without_nested_loops(spark, name):
    plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "NestedLoop", "CartesianProduct"):
        assert word not in plan


def test_rework_shuffles_whole_rows_once(spark):
    plan = queries()["rework_merge"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", re.sub(r"#\d+", "", plan))
    keyed = [e for e in exchanges if e.startswith("orderID, subIntID")]
    assert len(keyed) == 3  # rows, words of days, words per group


def test_scan_reads_only_used_columns(spark):
    plan = queries()["filter_between"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz>" in plan


def test_library_collects_no_tables():
    text = "\n".join(p.read_text() for p in PACKAGE.rglob("*.py"))
    for word in ("toPandas", "localCheckpoint", "crossJoin", ".rdd", "@F.udf", "pandas_udf"):
        assert word not in text


def test_decontamination_keeps_one_python_worker_per_task(spark):
    """A scan and a cut in steps of their own run in two workers at once, each with its batches."""
    docs = spark.createDataFrame([(1, "a b c", 5)], "doc_id long, text string, n_chars long")
    items = spark.createDataFrame([(1, "x y z")], "item_id long, text string")
    plan = decontaminate.decontaminated(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
