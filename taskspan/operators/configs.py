"""Training table and its statistics per attribute configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskspan.functions.numbers import at_least_one_day
from taskspan.functions.text import joined_key
from taskspan.operators.stats import (
    CONFIG_PERCENTILES, WIDE_PERCENTILES, backoff_quantiles, histogram, histogram_stats, interval_stats,
)
from taskspan.schema import CONFIG_KEYS, CONFIG_STATS_COLUMNS, DAYS, FEATURES, TRAIN_COLUMNS
from taskspan.sources.stage import stage


def train_table(tasks: DataFrame) -> DataFrame:
    """Ids, predictors, names and label; repeats without a business day count as one day."""
    return tasks.withColumn(DAYS, at_least_one_day(F.col(DAYS))).select(*TRAIN_COLUMNS)


def feature_table(tasks: DataFrame, *, order_id: bool = True) -> DataFrame:
    """The predictors and the label, with the order they belong to."""
    ids = ["orderID"] if order_id else []
    return tasks.select(*ids, *FEATURES, DAYS)


def config_stats(train: DataFrame) -> DataFrame:
    """Rounded statistics per configuration, led by its key; a missing part makes the key missing."""
    return config_stats_of(histogram(train, CONFIG_KEYS))


def config_stats_of(counts: DataFrame) -> DataFrame:
    """`config_stats` from a histogram per configuration, its own or a merged one."""
    stats = histogram_stats(
        counts, CONFIG_KEYS, percentiles=CONFIG_PERCENTILES, std="stddev", round_to=0)
    texts = {name: F.col(name).cast("string") for name in ("subIntID", "PID")}
    stats = stats.withColumns(texts).withColumn(
        "config", joined_key(*(F.col(k) for k in CONFIG_KEYS)))
    return stats.select(*(
        c for c in CONFIG_STATS_COLUMNS if c not in ("subIntervalName", "phaseName")))


def config_stats_named(stats: DataFrame, types: DataFrame) -> DataFrame:
    """Add task and phase names; configurations of unknown task types drop."""
    names = types.select(F.col("subIntID").cast("string"), "subIntervalName", "phaseName")
    return stats.join(names, "subIntID").select(*CONFIG_STATS_COLUMNS)


def config_stats_wide(tasks: DataFrame) -> DataFrame:
    """Rounded statistics over the configuration keys and two more order marks."""
    days = tasks.withColumn(DAYS, at_least_one_day(F.col(DAYS)))
    return interval_stats(
        days, [*CONFIG_KEYS, "is3rdpartycoloneeded", "isBuildingAdd"],
        percentiles=WIDE_PERCENTILES, round_to=0)


def stats_reconcile(stats: DataFrame, named: DataFrame) -> DataFrame:
    """Configurations and task rows before and after the names were joined."""
    def totals(df: DataFrame, when: str) -> DataFrame:
        return df.agg(
            F.count(F.lit(1)).alias("configs"), F.sum("count").alias("rows"),
        ).select(F.lit(when).alias("step"), "configs", "rows")

    return totals(stats, "before").union(totals(named, "after"))


def quantile_lookup(train: DataFrame, test: DataFrame, *, alpha: float = 0.75,
                    name: str = "Prediction") -> DataFrame:
    """Predict the alpha-quantile of a row's configuration, else of its task type, else of all rows.

    A distributed baseline with exact percentiles for the quantile model. `train` is read once, for
    one stored table of all three levels.
    """
    levels = [list(CONFIG_KEYS), ["subIntID"], []]
    table = stage(backoff_quantiles(train, levels, alpha=alpha), "backoff-quantiles")

    def at(level: int, column: str) -> DataFrame:
        return table.where(F.col("level") == level).select(
            *levels[level], F.col("quantile").alias(column))

    scored = test.join(at(0, "_config"), levels[0], "left").join(at(1, "_task"), levels[1], "left")
    overall = at(2, "_all").scalar()
    return scored.withColumn(name, F.coalesce("_config", "_task", overall)).drop("_config", "_task")
