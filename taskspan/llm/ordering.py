"""Ranks over tables that no single task can hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from taskspan.sources.stage import stage

_PARTITION_BITS = 33  # of monotonically_increasing_id: the row's place in its partition


def parts_of(spark: SparkSession) -> int:
    """Ranges that a table is dealt into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(table: DataFrame, order: Sequence[Column], within: Sequence[str] = (),
           name: str = "rank") -> DataFrame:
    """`table` with the place (from 0) of each row within its group, as a stored table.

    The rows are dealt into ranges of (within, order), so a group that holds a third of all rows is
    cut into many ranges. A row's place is its place in the range plus the group's rows in earlier
    ranges; the only window runs over one row per range and group. Nulls in `within` form a group.

    `table` must be a stored table: its rows are read twice and must come in the same order, as
    rows that tie in `order` are told apart by their place in the files. Rows that tie and are equal
    in all other columns are interchangeable, so the result is the same however they are placed.
    """
    partitions = parts_of(table.sparkSession)
    keyed = table.withColumn("_row", F.monotonically_increasing_id())
    keys = [*(F.col(c) for c in within), *order, F.col("_row")]
    placed = stage(
        keyed.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id()).drop("_row"), "ranked")
    placed = placed.withColumn("_range", F.shiftright("_place", _PARTITION_BITS))
    ranges = placed.groupBy("_range", *within).agg(
        F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*within).orderBy("_range")
    ranges = ranges.select(
        "_first", F.col("_range").alias("_r"), *(F.col(c).alias(f"_w_{c}") for c in within),
        (F.sum("_rows").over(before) - F.col("_rows")).alias("_before"))
    same = F.col("_range") == F.col("_r")
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"_w_{c}"))
    return placed.join(ranges, same).select(
        *table.columns, (F.col("_place") - F.col("_first") + F.col("_before")).alias(name))
