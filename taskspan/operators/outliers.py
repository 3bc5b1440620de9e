"""Outlier removal: rank trimming and percentile thresholds.

A rank within a task would need the whole task sorted in one place, and a task may hold a large
share of all rows. Trimming therefore works on counts: a histogram of days per task tells which
days are kept whole, which drop, and which single value the cut runs through. Only the rows tied at
that value need an order among themselves; they follow the MD5 of a few columns, then all columns,
and a second histogram over its leading digits leaves a sliver of them to rank row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskspan.functions.numbers import category_threshold, p99_category
from taskspan.operators.stats import TASK_PERCENTILES, histogram, interval_stats, task_group
from taskspan.schema import DAYS, MIN_TASK_ROWS, P99_BUCKETS, TRIM_FRACTION
from taskspan.sources.stage import stage

_SLICE_DIGITS = 4
_COPY_CHUNK = 10_000


def tie_order(columns: Sequence[str]) -> Column:
    """A fixed order among rows with equal days: the MD5 of some columns as text."""
    return F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in columns)))


def _rank_cuts(df: DataFrame, group: str, value: str,
               limits: Callable[[Column, Column], tuple[Column, Column]]) -> DataFrame:
    """Per group and value with kept rows: how many tied rows to skip (`_first`) and where to stop.

    `limits` maps the rows and the non-missing values of a group to the ranks (low, high] it keeps.
    Missing values rank last and a missing group is left out.
    """
    rows = histogram(df.where(F.col(group).isNotNull()), [group], value)
    whole = Window.partitionBy(group)
    upto = whole.orderBy(F.col(value).asc_nulls_last())
    low, high = limits(
        F.sum("rows").over(whole),
        F.sum(F.when(F.col(value).isNotNull(), F.col("rows")).otherwise(0)).over(whole),
    )
    before = F.sum("rows").over(upto) - F.col("rows")
    cuts = rows.withColumns({
        "_first": F.greatest(low - before, F.lit(0)),
        "_last": F.least(high - before, F.col("rows")),
    }).where(F.col("_last") > F.col("_first"))
    return stage(cuts.select(
        F.col(group).alias("_group"), F.col(value).alias("_value"), "_first", "_last",
        ((F.col("_first") == 0) & (F.col("_last") == F.col("rows"))).alias("_whole"),
    ), "rank-cuts")


def _tie_cuts(ties: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add to each cut value the slices its two ends fall into and the ranks within those slices."""
    key = ["_group", "_value"]
    running = Window.partitionBy(*key).orderBy("_slice")
    slices = ties.groupBy(*key, "_slice", "_first", "_last").agg(F.count(F.lit(1)).alias("rows"))
    after = F.sum("rows").over(running)
    slices = slices.withColumn("_after", after).withColumn("_before", F.col("_after") - F.col("rows"))
    starts = (F.col("_before") <= F.col("_first")) & (F.col("_first") < F.col("_after"))
    stops = (F.col("_before") < F.col("_last")) & (F.col("_last") <= F.col("_after"))
    ends = slices.groupBy(*key).agg(
        F.max(F.when(starts, F.col("_slice"))).alias("_low_slice"),
        F.max(F.when(starts, F.col("_first") - F.col("_before"))).alias("_skip"),
        F.max(F.when(stops, F.col("_slice"))).alias("_high_slice"),
        F.max(F.when(stops, F.col("_last") - F.col("_before"))).alias("_take"),
    ).withColumnsRenamed({"_group": "_tied_group", "_value": "_tied_value"})
    return stage(cuts.join(
        ends,
        (F.col("_group") == F.col("_tied_group")) & F.col("_value").eqNullSafe(F.col("_tied_value")),
        "left",
    ).drop("_tied_group", "_tied_value"), "tie-cuts")


def _with_cuts(df: DataFrame, group: str, value: str, cuts: DataFrame) -> DataFrame:
    """The cuts are stored, so the planner broadcasts them by their size; beyond that the adaptive
    skew join splits a common value."""
    return df.join(
        cuts, (F.col(group) == F.col("_group")) & F.col(value).eqNullSafe(F.col("_value")))


def _edge_rows(edges: DataFrame, columns: Sequence[str], order: Column) -> DataFrame:
    """Kept rows of the slices a cut runs through.

    Copies of a row are counted, not ranked one by one, and the kept ones written out again: first
    in chunks, which are spread over the cluster, then row by row.
    """
    cut = ["_group", "_value", "_slice", "_low_slice", "_skip", "_high_slice", "_take"]
    slice_ = F.col("_slice")
    running = Window.partitionBy("_group", "_value", "_slice").orderBy(
        "_order", *columns).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("_copies").over(running)
    counted = edges.groupBy(*columns, *cut).agg(F.count(F.lit(1)).alias("_copies")).withColumn(
        "_order", order).withColumn("_upto", upto)
    first = F.when(slice_ == F.col("_low_slice"), F.col("_skip")).otherwise(0)
    last = F.when(slice_ == F.col("_high_slice"), F.col("_take")).otherwise(F.col("_upto"))
    kept = F.least("_upto", last) - F.greatest(F.col("_upto") - F.col("_copies"), first)
    chunks = F.sequence(F.lit(0), F.floor((F.col("_kept") - 1) / _COPY_CHUNK))
    rest = F.col("_kept") - F.col("_chunk") * _COPY_CHUNK
    return (
        counted.withColumn("_kept", kept).where(F.col("_kept") > 0)
        .withColumn("_chunk", F.explode(chunks)).repartition(*columns, "_chunk")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least(rest, F.lit(_COPY_CHUNK)))))
        .select(*columns)
    )


def keep_ranks(df: DataFrame, *, group: str, value: str,
               limits: Callable[[Column, Column], tuple[Column, Column]],
               tiebreak: Sequence[str] | None = None) -> DataFrame:
    """Rows whose rank by value within their group lies in the range `limits` gives.

    `tiebreak` names columns that tell most rows apart, all columns by default; few columns make
    the pass over the tied rows narrow. `df` is read four times: pass a stored table.
    """
    columns = df.columns
    order = tie_order(tiebreak or columns)
    tied_slice = F.substring(order, 1, _SLICE_DIGITS)
    cuts = _rank_cuts(df, group, value, limits)
    ties = _with_cuts(df, group, value, cuts.where(~F.col("_whole"))).withColumn("_slice", tied_slice)
    cuts = _tie_cuts(ties, cuts)

    marked = _with_cuts(df, group, value, cuts).withColumn(
        "_slice", F.when(~F.col("_whole"), tied_slice))
    slice_, low, high = F.col("_slice"), F.col("_low_slice"), F.col("_high_slice")
    inside = marked.where(F.col("_whole") | ((slice_ > low) & (slice_ < high)))
    edges = marked.where(~F.col("_whole") & ((slice_ == low) | (slice_ == high)))
    return inside.select(*columns).unionAll(_edge_rows(edges, columns, order))


def _share(count: Column, part: Fraction) -> Column:
    """floor(count * part), in whole numbers."""
    product = count.cast("decimal(38,0)") * F.lit(part.numerator)
    divisor = F.lit(part.denominator)
    return ((product - product % divisor) / divisor).cast("long")


def _fraction(frac: float, below: float) -> Fraction:
    """The decimal number as it is written, exactly."""
    if not 0 <= frac < below:
        raise ValueError(f"frac must be at least 0 and less than {below}")
    return Fraction(str(frac))


def trim_bottom(df: DataFrame, *, group: str = "subIntervalName", value: str = DAYS,
                frac: float = TRIM_FRACTION, min_count: int = MIN_TASK_ROWS,
                keep_small: bool = False, tiebreak: Sequence[str] | None = None) -> DataFrame:
    """Drop the shortest tenth of each task; tasks under `min_count` rows drop, or stay on request."""
    part = _fraction(frac, 1)

    def limits(rows: Column, values: Column) -> tuple[Column, Column]:
        small = values < min_count
        low = F.when(small, F.lit(0) if keep_small else rows).otherwise(_share(values, part))
        return low, rows

    return keep_ranks(df, group=group, value=value, limits=limits, tiebreak=tiebreak)


def trim_both(df: DataFrame, *, group: str = "subIntervalName", value: str = DAYS,
              frac: float = TRIM_FRACTION, min_count: int = MIN_TASK_ROWS,
              tiebreak: Sequence[str] | None = None) -> DataFrame:
    """Drop the shortest and the longest tenth of each task with more than `min_count` rows.

    Of n rows the ranks over floor(n * frac), up to floor(n * (1 - frac)), stay.
    """
    part = _fraction(frac, 0.5)

    def limits(rows: Column, values: Column) -> tuple[Column, Column]:
        small = rows <= min_count
        return (
            F.when(small, F.lit(0)).otherwise(_share(rows, part)),
            F.when(small, rows).otherwise(_share(rows, 1 - part)),
        )

    return keep_ranks(df, group=group, value=value, limits=limits, tiebreak=tiebreak)


def tasks_with_rows(df: DataFrame, *, group: str = "subIntervalName", value: str = DAYS,
                    min_count: int = MIN_TASK_ROWS) -> DataFrame:
    """Rows of the tasks that reach `min_count` rows."""
    names = task_group(df, [group], value).where(F.col("count") >= min_count).select(group)
    return df.join(stage(names, "task-names"), group, "left_semi")


def task_thresholds(df: DataFrame, *, keys: Sequence[str] = ("subIntervalName", "subIntID"),
                    value: str = DAYS, buckets: Sequence[tuple] = P99_BUCKETS) -> DataFrame:
    """Statistics per task with the P99 bucket and the longest duration kept."""
    stats = interval_stats(df, keys, value=value, percentiles=TASK_PERCENTILES)
    return stats.withColumn(
        "Category", p99_category(F.col("percentile_99"), buckets)
    ).withColumn("Outlier_threshold", category_threshold(F.col("Category"), buckets))


def join_thresholds(df: DataFrame, thresholds: DataFrame,
                    join_keys: Sequence[str] = ("subIntervalName",)) -> DataFrame:
    """Give each row the category and threshold of its task.

    Joining on the name alone repeats the rows of names that several task ids share.
    """
    side = thresholds.select(*join_keys, "Category", "Outlier_threshold")
    return df.join(stage(side, "thresholds"), list(join_keys))


def threshold_outliers(df: DataFrame, *, join_keys: Sequence[str] = ("subIntervalName",),
                       value: str = DAYS, buckets: Sequence[tuple] = P99_BUCKETS) -> DataFrame:
    """Drop rows that took longer than the threshold of their task."""
    joined = join_thresholds(df, task_thresholds(df, value=value, buckets=buckets), join_keys)
    return joined.where(F.col(value) <= F.col("Outlier_threshold"))
