"""Training and test preparation.

Only the extracts shuffle whole task rows. Their result is stored; what follows is a chain of
filters, expressions and joins with small stored tables, up to the one aggregation that merges
repeated tasks. The training rows are stored twice more on the way, trimmed and binned, as both are
read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskspan.operators.categories import bin_rare, rare_categories
from taskspan.operators.clean import add_cancelled, append_rows, clean, split_by_jeop, task_table
from taskspan.operators.extract import (
    extract_cancelled_dependency, extract_orders, extract_tasks,
)
from taskspan.operators.outliers import threshold_outliers, trim_both, trim_bottom
from taskspan.operators.rework import NULLABLE_COLUMNS, missing_columns, rework_merge
from taskspan.schema import DAYS, TASK_COLUMNS, TASK_IDS, TASK_SCHEMA, check_schema
from taskspan.sources.stage import counted, counted_rows, stage
from taskspan.sources.tables import Warehouse


def rare_order_categories(source: Warehouse, *, window: tuple[str, str],
                          mode: str = "faithful") -> DataFrame:
    """Rare categories among the cleaned orders of the window."""
    orders = clean(extract_orders(source, window=window, mode=mode),
                   interval_col="orderIntervalDays")
    return rare_categories(orders)


def binned_stages(source: Warehouse, *, window: tuple[str, str], mode: str = "faithful",
                  keep_small: bool = False,
                  include_cancelled: bool = False) -> dict[str, DataFrame]:
    """The steps of the training preparation before the merge by name, in order.

    Stored are the extract, the trimmed and the binned rows, each of which is read more than once.
    """
    extracted = stage(counted(extract_tasks(source, window=window, mode=mode), "extracted",
                              cleaned=F.col(DAYS) >= 0), "tasks")
    cleaned = clean(extracted)
    trimmed = stage(counted(
        trim_bottom(cleaned, keep_small=keep_small, tiebreak=TASK_IDS), "trimmed"), "trimmed")
    keys = ("subIntervalName",) if mode == "faithful" else ("subIntervalName", "subIntID")
    thresholded = threshold_outliers(trimmed, join_keys=keys)
    binned = task_table(
        bin_rare(counted(thresholded, "thresholded"),
                 rare_order_categories(source, window=window, mode=mode)))
    if include_cancelled:
        binned = add_cancelled(
            binned, extract_cancelled_dependency(source, window=window, mode=mode))
    check_schema(binned, TASK_SCHEMA, "binned tasks")
    return {
        "extracted": extracted, "cleaned": cleaned, "trimmed": trimmed,
        "thresholded": thresholded, "binned": stage(counted(binned, "binned"), "binned"),
    }


def train_stages(source: Warehouse, *, window: tuple[str, str], from_year: int,
                 recompute_singles: bool = False, form: str = "dates",
                 **options) -> dict[str, DataFrame]:
    """Every step of the training preparation by name, in order.

    `mode="repaired"` counts days across year ends, takes the last day of the window whole and
    looks thresholds up by task id as well as name.
    """
    stages = binned_stages(source, window=window, **options)
    columns = TASK_COLUMNS if options.get("include_cancelled") else NULLABLE_COLUMNS
    merged = rework_merge(
        stages["binned"], source.calendar, from_year=from_year,
        nullable=missing_columns(stages["binned"], columns),
        recompute_singles=recompute_singles, form=form)
    return stages | {"merged": merged}


def stage_counts(source: Warehouse, **options) -> DataFrame:
    """Rows per step of the training preparation, counted while the steps are written.

    No step is run again to be counted; the merged rows are written too.
    """
    with counted_rows() as found:
        merged = counted(train_stages(source, **options)["merged"], "merged")
        stage(merged, "merged")
    rows = [pair for seen in found.values() for pair in seen.get.items()]
    return source.tasks.sparkSession.createDataFrame(rows, "stage string, rows long")


def prepare_train(source: Warehouse, **options) -> DataFrame:
    """Training rows: one per order and task, outliers removed. Options as in `train_stages`."""
    return train_stages(source, **options)["merged"]


def prepare_test(source: Warehouse, *, window: tuple[str, str], mode: str = "faithful",
                 rare: DataFrame | None = None) -> DataFrame:
    """Test rows on the original dates; dependency tasks are not trimmed.

    Categories stay as they are unless a list of rare ones is given.
    """
    extracted = stage(extract_tasks(
        source, window=window, start_col="originalstartDate",
        complete_col="originalcompleteDate", keep_ids=False, mode=mode), "test-tasks")
    plain, jeop = split_by_jeop(clean(extracted))
    result = task_table(append_rows(trim_both(plain), jeop))
    check_schema(result, TASK_SCHEMA, "test tasks")
    return result if rare is None else bin_rare(stage(result, "test-rows"), rare)
