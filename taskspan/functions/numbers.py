"""Interval, rounding and bucketing expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from taskspan.schema import P99_BUCKETS


def at_least_one_day(days: Column) -> Column:
    """A task that starts and ends on the same day took one day."""
    return F.when(days == 0, F.lit(1)).otherwise(days)


def p99_category(p99: Column, buckets: Sequence[tuple] = P99_BUCKETS) -> Column:
    """Name of the first bucket whose upper end is not exceeded; NULL without a percentile."""
    label = F.when(p99.isNull(), F.lit(None))
    for name, top, _ in buckets:
        label = label.when(p99 <= top, F.lit(name)) if top is not None else label.otherwise(F.lit(name))
    return label


def category_threshold(category: Column, buckets: Sequence[tuple] = P99_BUCKETS) -> Column:
    """Longest duration kept for the bucket."""
    name, _, days = buckets[0]
    threshold = F.when(category == name, F.lit(days))
    for name, _, days in buckets[1:]:
        threshold = threshold.when(category == name, F.lit(days))
    return threshold


def round_half_even(value: Column) -> Column:
    """Whole number nearest to the value; halves go to the even neighbour."""
    return F.bround(value, 0)


def jeop_flag(task_jeop: Column) -> Column:
    """'N' for tasks without a dependency code, else 'Y'."""
    return F.when(task_jeop == "None", F.lit("N")).otherwise(F.lit("Y"))


def pinball(actual: Column, predicted: Column, alpha: float) -> Column:
    """Quantile loss of one prediction."""
    error = actual - predicted
    return F.greatest(error * F.lit(alpha), error * F.lit(alpha - 1.0))
