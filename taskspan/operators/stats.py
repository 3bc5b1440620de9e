"""Grouped counts and exact statistics of whole-day intervals.

Days take few distinct values, so every statistic starts from a histogram: one partial aggregation
shrinks even the hottest group to its distinct days before anything is shuffled. Sums over the
histogram are exact, so results do not depend on the order of the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskspan.schema import DAYS, MIN_TASK_ROWS

TASK_PERCENTILES = {
    "percentile_50": 0.5, "percentile_60": 0.6, "percentile_75": 0.75, "percentile_80": 0.8,
    "percentile_95": 0.95, "percentile_99": 0.99,
}
CONFIG_PERCENTILES = {
    "median": 0.5, "percentile_60": 0.6, "percentile_70": 0.7, "percentile_75": 0.75,
    "percentile_80": 0.8,
}
WIDE_PERCENTILES = {
    "percentile_25": 0.25, "median": 0.5, "percentile_60": 0.6, "percentile_75": 0.75,
    "percentile_80": 0.8, "percentile_99": 0.99,
}
QUARTILES = {"percentile_25": 0.25, "percentile_50": 0.5, "percentile_75": 0.75}

_WHOLE_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def task_group(df: DataFrame, keys: Sequence[str], value: str = DAYS) -> DataFrame:
    """Rows with a value per group."""
    return df.groupBy(*keys).agg(F.count(value).alias("count"))


def histogram(df: DataFrame, keys: Sequence[str], value: str = DAYS) -> DataFrame:
    """Rows per group and distinct value, as column `rows`.

    This is the whole state of the statistics below: stored histograms of several windows are merged
    by `merge_histograms`, and the rows of earlier windows need not be read again.
    """
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("rows"))


def merge_histograms(parts: Sequence[DataFrame], keys: Sequence[str],
                     value: str = DAYS) -> DataFrame:
    """The histogram of all rows that the parts count."""
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    return together.groupBy(*keys, value).agg(F.sum("rows").alias("rows"))


def interval_stats(df: DataFrame, keys: Sequence[str], *, value: str = DAYS,
                   percentiles: Mapping[str, float] = TASK_PERCENTILES, std: str = "std",
                   round_to: int | None = None) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact percentiles and maximum per group.

    Percentiles interpolate linearly. `round_to` rounds every statistic, halves up.
    """
    return histogram_stats(histogram(df, keys, value), keys, value=value, percentiles=percentiles,
                           std=std, round_to=round_to)


def histogram_stats(df: DataFrame, keys: Sequence[str], *, value: str = DAYS,
                    percentiles: Mapping[str, float] = TASK_PERCENTILES, std: str = "std",
                    round_to: int | None = None) -> DataFrame:
    """The statistics of `interval_stats` from a histogram, its own or a merged one."""
    if not isinstance(df.schema[value].dataType, _WHOLE_TYPES):
        raise TypeError(f"{value} must hold whole days")
    days, rows = F.col(value), F.col("rows")
    exact_days = days.cast("decimal(10,0)")
    exact_rows = F.when(days.isNotNull(), rows).otherwise(0).cast("decimal(18,0)")
    sums = df.groupBy(*keys).agg(
        F.sum(exact_rows).cast("long").alias("count"),
        F.sum(exact_days * exact_rows).cast("decimal(38,0)").alias("_sum"),
        F.sum(exact_days * exact_days * exact_rows).cast("decimal(38,0)").alias("_squares"),
        F.min(days).alias("min"),
        F.max(days).alias("max"),
        F.percentile(days, list(percentiles.values()), rows).alias("_percentiles"),
    )
    n = F.col("count")
    spread = (
        n.cast("decimal(19,0)") * F.col("_squares") - F.col("_sum") * F.col("_sum")
    ).cast("double")
    columns: dict[str, Column] = {
        "count": n,
        "mean": F.try_divide(F.col("_sum").cast("double"), n.cast("double")),
        std: F.when(n > 1, F.sqrt(spread / (n.cast("double") * (n - 1).cast("double")))),
        "min": F.col("min"),
        **{name: F.col("_percentiles")[i] for i, name in enumerate(percentiles)},
        "max": F.col("max"),
    }
    if round_to is not None:
        columns = {name: F.round(column, round_to) for name, column in columns.items()}
    return sums.select(*keys, *(column.alias(name) for name, column in columns.items()))


def backoff_quantiles(df: DataFrame, levels: Sequence[Sequence[str]], *, alpha: float,
                      value: str = DAYS) -> DataFrame:
    """The alpha-quantile per group of several levels of keys, from one pass over the rows.

    The first level has all keys, the others some of them or none. The rows are counted once per
    group of the first level and value; grouping sets over these counts give every level. A row has
    the number of its `level`, its keys (others missing) and `quantile`.
    """
    keys = list(levels[0])
    if any(not set(level) <= set(keys) for level in levels):
        raise ValueError("the first level must have the keys of all others")
    # grouping_id has a bit per key, set where the key is left out; the first key leads
    ids = [sum(1 << i for i, key in enumerate(reversed(keys)) if key not in level)
           for level in levels]
    found = histogram(df, keys, value).groupingSets([list(level) for level in levels], *keys).agg(
        F.grouping_id().alias("_id"), F.percentile(value, alpha, F.col("rows")).alias("quantile"))
    number = F.array_position(F.array(*(F.lit(x).cast("long") for x in ids)), F.col("_id")) - 1
    return found.select(number.cast("int").alias("level"), *keys, "quantile")


def describe(df: DataFrame, value: str = DAYS) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles and maximum of a column, to five decimals."""
    return interval_stats(df, [], value=value, percentiles=QUARTILES, round_to=5)


def task_size_split(counts: DataFrame, min_count: int = MIN_TASK_ROWS) -> DataFrame:
    """How many tasks reach `min_count` rows and how many do not."""
    enough = F.col("count") >= min_count
    return counts.agg(
        F.count_if(enough).alias("tasks_enough"), F.count_if(~enough).alias("tasks_few"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency of each value, most frequent first, missing values left out."""
    return (
        df.where(F.col(column).isNotNull()).groupBy(column)
        .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), column)
    )


def n_unique(df: DataFrame, column: str, *, approximate: bool = False) -> DataFrame:
    """Number of distinct values, missing ones left out; a sketch's estimate on request."""
    count = F.approx_count_distinct(column) if approximate else F.count_distinct(column)
    return df.agg(count.alias("n_unique"))


def audit(stages: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per stage."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("stage"), "rows")
        for name, df in stages.items()
    ]
    result = counts[0]
    for part in counts[1:]:
        result = result.union(part)
    return result
