"""Joins and pipelines with one key that holds a third of the rows."""

import pytest
from compare import difference, duck
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from taskspan.sources.stage import stage_path


@pytest.fixture(scope="module")
def skewed_folder(spark):
    """The test tables with a third of the line items on one order and one part."""
    folder = stage_path(spark, "skewed")
    sf = "/root/testdata/sf0.01"
    spark.read.parquet(f"{sf}/part.parquet").write.parquet(f"{folder}/part.parquet")
    spark.read.parquet(f"{sf}/customer.parquet").write.parquet(f"{folder}/customer.parquet")
    orders = spark.read.parquet(f"{sf}/orders.parquet").cache()
    orders.write.parquet(f"{folder}/orders.parquet")
    eligible = orders.where(
        "o_orderstatus = 'F' and o_orderkey % 8 < 5 and o_orderkey % 9 <> 3 and "
        "o_custkey % 5 <> 2 and o_custkey % 8 < 7 and o_orderdate < '2000-01-01'")
    key = eligible.agg(F.min("o_orderkey")).first()[0]
    third = F.crc32(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").cast("binary")) % 3
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    items.withColumn("_hot", third == 0).withColumns({
        "l_orderkey": F.when(F.col("_hot"), F.lit(key)).otherwise(F.col("l_orderkey")),
        "l_partkey": F.when(F.col("_hot"), F.lit(42).cast("long")).otherwise(F.col("l_partkey")),
    }).drop("_hot").write.parquet(f"{folder}/lineitem.parquet")
    return folder.removeprefix("file:")


SHUFFLED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture
def shuffled(spark):
    """Every join is a shuffle, and a partition is large from 8 kB on."""
    old = {name: spark.conf.get(name) for name in SHUFFLED}
    for name, value in SHUFFLED.items():
        spark.conf.set(name, value)
    yield
    for name, value in old.items():
        spark.conf.set(name, value)


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_order_rows_are_broadcast(spark, skewed_folder):
    plan = executed(queries()["extract_tasks"](spark, skewed_folder))
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_the_hot_order_is_split(spark, skewed_folder, shuffled):
    plan = executed(queries()["extract_tasks"](spark, skewed_folder))
    assert "SortMergeJoin(skew=true)" in plan


@pytest.mark.parametrize("name", ["extract_tasks", "extract_cancelled", "task_repeat_count"])
def test_no_rows_meet_in_one_task(spark, skewed_folder, name):
    plan = queries()[name](spark, skewed_folder)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("name", [
    "extract_tasks", "trim_bottom", "threshold_outliers", "task_repeat_count", "rework_merge",
    "rework_days", "prepare_train", "prepare_test", "config_stats_named", "quantile_lookup",
])
def test_pipelines_hold_under_skew(spark, skewed_folder, shuffled, name):
    connection = duck(skewed_folder, "/*.parquet")
    difference_ = difference(
        queries()[name](spark, skewed_folder), connection, oracle_sql()[name])
    assert difference_ is None
