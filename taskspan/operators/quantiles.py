"""Exact quantiles of many groups at once, however many distinct values one group has.

`percentile` holds the distinct values of a group in one task. Here every group has a bracket that
holds its rank; the bracket is cut into cells, the rows of all groups' cells are counted by one
aggregation, and the cell with the rank is the next bracket, until it is a single value. A task holds
at most the cells of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskspan.sources.stage import stage

CELLS = 1_024


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, alpha: float, *,
                    weight: str | None = None, name: str = "quantile") -> DataFrame:
    """The interpolated alpha-quantile of a real column per group, as `percentile` gives it.

    `weight` is a whole number of rows that a row stands for, one by default. Missing and non-finite
    values and rows of weight zero are left out; a group without others has a missing quantile. A
    missing key is a group. An empty table has no groups.
    """
    number = [f"_k{i}" for i in range(len(keys))]
    names = [F.col(k).alias(n) for k, n in zip(keys, number)]
    v = F.col(value).cast("double")
    rows = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    usable = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & (rows > 0)
    values = stage(df.select(*names, F.when(usable, v).alias("v"), F.when(usable, rows).alias("w"))
                   .groupBy(*number, "v").agg(F.sum("w").alias("w")), "group-values")
    position = (F.col("n") - 1) * F.lit(float(alpha))
    state = stage(values.groupBy(*number).agg(
        F.sum("w").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
    ).select("*", F.lit(0).cast("long").alias("before"), F.col("n").alias("rows"),
             F.floor(position).alias("rank")), "brackets")
    done = [state.where("low is null or low = high")]
    state = state.where("low < high")
    while not state.isEmpty():
        state = stage(_narrowed(values, state, number), "brackets")
        done.append(state.where("low = high"))
        state = state.where("low < high")

    found = done[0]
    for part in done[1:]:
        found = found.unionAll(part)
    found = stage(found.withColumn("position", position), "ranks")
    # the next value counts only where the position lies beyond the last row of this one
    split = (F.col("position") > F.col("rank")) & (F.col("rank") + 1 >= F.col("before") + F.col("rows"))
    following = stage(_joined(values, found.where(split), number).where(F.col("v") > F.col("low")).groupBy(
        *number).agg(F.min("v").alias("next")), "following")
    share = F.col("position") - F.col("rank")
    quantile = F.when(F.col("next").isNull(), F.col("low")).otherwise(
        (F.col("rank") + 1 - F.col("position")) * F.col("low") + share * F.col("next"))
    return _joined(found, following, number, "left").select(
        *(F.col(n).alias(k) for n, k in zip(number, keys)), quantile.alias(name))


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be missing; the columns of the right side but its keys are added."""
    if not keys:  # both sides describe the one group; the right one is a row
        return left.join(F.broadcast(right), F.lit(True), how)
    other = right.withColumnsRenamed({k: f"{k}_" for k in keys})
    same = [left[k].eqNullSafe(other[f"{k}_"]) for k in keys]
    return left.join(other, same, how).drop(*(f"{k}_" for k in keys))


def _cell(v: Column) -> Column:
    """The cell of a value; the ends of a bracket are always in different ones."""
    low, high = F.col("low"), F.col("high")
    width = high / CELLS - low / CELLS
    place = F.floor(F.try_divide(v - low, width))
    return F.when(v >= high, CELLS - 1).when(v <= low, 0).otherwise(
        F.least(F.greatest(F.coalesce(place, F.lit(0)), F.lit(0)), F.lit(CELLS - 1)))


def _narrowed(values: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each bracket cut down to the least and greatest value of the cell that holds its rank.

    A group is kept whole by none of the tasks: its rows are counted by cell where they lie.
    """
    inside = _joined(values, state.drop("rows"), keys).where(F.col("v").between(F.col("low"), F.col("high")))
    cells = inside.groupBy(*keys, "n", "before", "rank", _cell(F.col("v")).alias("cell")).agg(
        F.min("v").alias("low"), F.max("v").alias("high"), F.sum("w").alias("rows"))
    upto = F.sum("rows").over(Window.partitionBy(*keys).orderBy("cell"))
    return cells.withColumn("before", F.col("before") + upto - F.col("rows")).where(
        (F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("rows"))
    ).select(*keys, "n", "low", "high", "before", "rows", "rank")
