"""Error measures of predictions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskspan.functions.numbers import pinball
from taskspan.sources.stage import stage

_CELLS = 1_024
_FEW = 50_000


def exact_quantile(df: DataFrame, value: str, p: float, name: str) -> DataFrame:
    """Interpolated quantile of a real column, as one row; missing without values.

    The range of the values is cut into a fixed number of cells and their rows are counted, and the
    cell that holds the rank is cut again, until few rows or a single value are left in it. Only
    those are put in order. The driver sees one count per cell, never the values.
    """
    spark = df.sparkSession
    values = stage(df.where(F.col(value).isNotNull()).select(
        F.col(value).cast("double").alias("v")), "values")
    v = F.col("v")
    rows, low, high = values.agg(F.count(v), F.min(v), F.max(v)).first()
    if not rows:
        return spark.range(1).select(F.lit(None).cast("double").alias(name))
    position, before = (rows - 1) * p, 0
    rank = math.floor(position)
    while rows > _FEW and low < high:
        width = (high - low) / _CELLS
        cell = F.least(F.floor((v - F.lit(low)) / F.lit(width)), F.lit(_CELLS - 1))
        cells = values.where(v.between(low, high)).groupBy(cell.alias("cell")).agg(
            F.count(v), F.min(v), F.max(v)).orderBy("cell").collect()  # at most _CELLS rows
        if len(cells) == 1:
            break  # neighbouring floating point numbers
        for _, rows, low, high in cells:
            if rank < before + rows:
                break
            before += rows
    if low == high:
        at, following = low, low if rank + 1 < before + rows else None
    else:
        inside = values.where(v.between(low, high)).agg(F.sort_array(F.collect_list(v)).alias("s"))
        at, following = inside.select(
            F.get("s", F.lit(rank - before)), F.get("s", F.lit(rank - before + 1))).first()
    if following is None and position > rank:
        following = values.where(v > high).agg(F.min(v)).first()[0]
    if position > rank:
        at += (following - at) * (position - rank)
    return spark.range(1).select(F.lit(at).alias(name))


def eval_metrics(df: DataFrame, *, actual: str = "Actual",
                 predicted: str = "Prediction") -> DataFrame:
    """RMSE, MAE, R² and median absolute error as one row. `df` is read three times."""
    error = F.col(actual) - F.col(predicted)
    median = exact_quantile(
        df.select(F.abs(error).alias("error")), "error", 0.5, "median_ae")
    scored = df.select(F.col(actual).cast("double").alias("y"), error.cast("double").alias("e"))
    sums = scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("e") * F.col("e")).alias("sse"),
        F.avg(F.abs("e")).alias("mae"),
        (F.var_pop("y") * F.count("y")).alias("sst"),
    )
    return sums.select(
        "n",
        F.sqrt(F.try_divide("sse", "n")).alias("rmse"),
        "mae",
        (1 - F.try_divide("sse", "sst")).alias("r2"),
        median.scalar().alias("median_ae"),
    )


def pinball_loss(df: DataFrame, alpha: float, *, actual: str = "Actual",
                 predicted: str = "Prediction") -> DataFrame:
    """Mean quantile loss and the share of rows at or under the prediction, as one row."""
    return df.agg(
        F.avg(pinball(F.col(actual), F.col(predicted), alpha)).alias("pinball_loss"),
        F.avg((F.col(actual) <= F.col(predicted)).cast("double")).alias("coverage"),
    )
