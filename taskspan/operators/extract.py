"""Extracts: source tables to task rows and order rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskspan.functions import text
from taskspan.operators.keyfilter import KeyFilter
from taskspan.schema import (
    DAYS, DEPENDENCY_CODES, EXCLUDED_ORDER_TYPE, INCLUDED_FLAGS, SOURCE_SYSTEMS,
)
from taskspan.sources.layout import MONTH, beside, in_months
from taskspan.sources.stage import stage
from taskspan.sources.tables import Warehouse


def in_window(moment: Column, window: tuple[str, str], mode: str = "faithful") -> Column:
    """Rows dated within the window.

    Faithful compares with midnight of the last day, so later hours of that day fall out; repaired
    takes the whole last day.
    """
    first, last = (F.to_date(F.lit(day)) for day in window)
    if mode == "repaired":
        return (moment >= first) & (moment < F.date_add(last, 1))
    return moment.between(first, last)


def eligible_orders(orders: DataFrame, *, status: str, flags: tuple[str, ...] = INCLUDED_FLAGS,
                    window: tuple[str, str] | None = None, mode: str = "faithful") -> DataFrame:
    """Orders an extract may use. A missing value fails its test, as in SQL."""
    kept = orders.where(
        (F.col("status") == status)
        & text.has_text(F.col("orderAction"))
        & F.col("sourceSystem").isin(*SOURCE_SYSTEMS)
        & (F.col("inidordertype") != EXCLUDED_ORDER_TYPE)
        & F.col("IncludedFlag").isin(*flags)
    )
    if window:
        kept = in_months(kept.where(in_window(F.col("completedate"), window, mode)), window)
    return kept


def live_tasks(tasks: DataFrame) -> DataFrame:
    """Task instances that are neither deleted nor inserted; an unknown insert mark drops too."""
    return tasks.where((F.col("deleteind") == "N") & (F.col("isinserted") != 1))


def with_interval(df: DataFrame, calendar: DataFrame, start: str, complete: str, *,
                  name: str = DAYS, mode: str = "faithful") -> DataFrame:
    """Add the days between two dates, both looked up in the calendar.

    Faithful subtracts the days' numbers within their years, which is negative for most spans over
    a year end; repaired counts the days. Rows with a date outside the calendar drop in both. The
    calendar has one row per day.
    """
    begin = calendar.select(F.col("date").alias("_begin"), F.col("daynuminyear").alias("_first"))
    end = calendar.select(F.col("date").alias("_end"), F.col("daynuminyear").alias("_last"))
    joined = (
        df.join(begin, F.to_date(F.col(start)) == F.col("_begin"))
        .join(end, F.to_date(F.col(complete)) == F.col("_end"))
    )
    days = (
        F.date_diff(F.col("_end"), F.col("_begin")) if mode == "repaired"
        else F.col("_last") - F.col("_first")
    )
    return joined.withColumn(name, days).drop("_begin", "_end", "_first", "_last")


def task_types(dictionary: DataFrame, phases: DataFrame, *, all_types: bool = False) -> DataFrame:
    """Task types with the name of their phase; first-day types only on request."""
    kept = dictionary if all_types else dictionary.where(F.col("isfdtask") == 0)
    return kept.join(phases, "PID").select(
        F.col("SubIntID").alias("subIntID"),
        F.col("SubIntervalName").alias("subIntervalName"),
        "PID",
        "phaseName",
    )


def star_join(orders: DataFrame, attributes: DataFrame, tasks: DataFrame,
              types: DataFrame) -> DataFrame:
    """Orders with their attributes, tasks and task types.

    The orders of the window are stored before they meet the attributes, and the order rows before
    they meet the tasks. So the planner knows the bytes of both: under its broadcast threshold
    nothing large is shuffled. Otherwise the tables meet on `sourcekey`, and the adaptive skew join
    splits the partition of an order that owns a large share of the tasks. Where the orders are many,
    attributes and tasks of other orders are left out by a bitmap of the keys while they are scanned,
    but for a few, so that what is shuffled follows the orders of the window. The types come last, so that their names are
    not part of the shuffled rows. Of tables laid out by month, only the months of the stored orders
    are read.
    """
    orders = stage(orders, "orders")
    known = KeyFilter(orders, "sourcekey")
    order_rows = stage(known.may_hold(beside(attributes, orders)).join(
        orders.drop(MONTH), "sourcekey"), "order-rows")
    return known.may_hold(beside(tasks, orders)).join(order_rows, "sourcekey").join(types, "subIntID")


def _order_columns() -> dict[str, Column]:
    return {
        "ProjectType": text.default_for_null(F.col("ProjectType"), "None"),
        "T_projecttype": text.default_for_blank(F.col("T_projecttype"), "None"),
        "IMPPOS2": text.default_for_null(F.col("IMPPOS2"), "None"),
        "orderClassType": text.default_for_blank(F.col("orderclasstype"), "None", "Null"),
        "orderAction": text.default_for_null(F.col("orderAction"), "None"),
        "orderDescription": text.default_for_blank(F.col("orderDescription"), "None"),
        "is3rdpartycoloneeded": text.default_for_null(F.col("is3rdpartycoloneeded"), "false"),
        "creatorGroup": text.default_for_null(F.col("creatorGroup"), "None"),
        "WorkGroup": text.default_for_null(F.col("WorkGroup"), "None"),
        "PDNOrder": text.default_for_null(F.col("PDNOrder"), "false"),
        "isBuildingAdd": text.default_for_null(F.col("IsBuildingAdd"), "false"),
        "categoryCD": text.default_for_null(F.col("categoryCd"), "None"),
        "QtyOfCircuits": text.default_for_null(F.col("QtyOfCircuits"), 0),
        "Expedite": text.default_for_blank(F.col("Expedite"), "N"),
        "taskJeop": text.default_for_null(F.col("taskJeop"), "None"),
    }


def _named(columns: dict[str, Column]) -> list[Column]:
    return [column.alias(name) for name, column in columns.items()]


def extract_tasks(source: Warehouse, *, window: tuple[str, str], start_col: str = "startDate",
                  complete_col: str = "completeDate", keep_ids: bool = True,
                  mode: str = "faithful") -> DataFrame:
    """Distinct task rows of completed orders.

    With `keep_ids` the rows carry `_id` and `taskid`, and their dates the spelling `startdate` and
    `completedate`; without, more rows fall together. `start_col` and `complete_col` choose between
    the current and the original dates.
    """
    orders = eligible_orders(source.orders, status="Completed", window=window, mode=mode)
    tasks = live_tasks(source.tasks)
    rows = star_join(
        orders.drop("completedate"), source.attributes, tasks,
        task_types(source.dictionary, source.phases),
    )
    rows = with_interval(rows, source.calendar, start_col, complete_col, mode=mode)
    ids = ["_id", "taskid"] if keep_ids else []
    dates = ("startdate", "completedate") if keep_ids else ("startDate", "completeDate")
    return rows.select(
        "orderID", "subIntID", *ids, "subIntervalName", "owner", "PID", "phaseName",
        "sourceSystem", F.col(start_col).alias(dates[0]), F.col(complete_col).alias(dates[1]),
        DAYS, *_named(_order_columns()),
    ).distinct()


def extract_orders(source: Warehouse, *, window: tuple[str, str],
                   mode: str = "faithful") -> DataFrame:
    """One row per completed order with its own interval; copies stay, missing dates drop."""
    orders = eligible_orders(source.orders, status="Completed", window=window, mode=mode).where(
        F.col("completedate").isNotNull() & F.col("orderWfStart").isNotNull())
    if MONTH in orders.columns:
        orders = stage(orders, "orders")
    rows = with_interval(
        orders.join(beside(source.attributes, orders), "sourcekey"), source.calendar, "orderWfStart",
        "completedate", name="orderIntervalDays", mode=mode,
    )
    return rows.select(
        "orderID",
        "sourceSystem",
        "orderIntervalDays",
        text.default_for_null(F.col("ProjectType"), "None").alias("ProjectType"),
        text.default_for_blank(F.col("T_projecttype"), "None").alias("T_projecttype"),
        text.default_for_null(F.col("IMPPOS2"), "None").alias("IMPPOS2"),
        text.default_for_blank(F.col("orderclasstype"), "None").alias("orderClassType"),
        F.col("ordertype").alias("orderType"),
        "is3rdpartycoloneeded",
        "creatorGroup",
        F.col("WorkGroup").alias("workGroup"),
        F.col("IsBuildingAdd").alias("isBuildingAdd"),
        F.col("categoryCd").alias("categoryCD"),
        "orderAction",
        text.default_for_blank(F.col("orderDescription"), "None").alias("orderDescription"),
        text.default_for_blank(F.col("Expedite"), "N").alias("Expedite"),
        "CLECILEC",
    )


def extract_cancelled_dependency(source: Warehouse, *, window: tuple[str, str],
                                 codes: tuple[str, ...] = DEPENDENCY_CODES,
                                 mode: str = "faithful") -> DataFrame:
    """Distinct dependency tasks of cancelled orders, by the completion of the task.

    Deleted, inserted and first-day tasks stay in, and most blanks are kept: this extract has fewer
    rules than the others.
    """
    orders = eligible_orders(source.orders, status="Cancelled", flags=("Y",))
    tasks = source.tasks.where(
        F.col("taskJeop").isin(*codes) & in_window(F.col("completeDate"), window, mode))
    rows = star_join(
        orders.drop("completedate"), source.attributes, tasks,
        task_types(source.dictionary, source.phases, all_types=True),
    )
    rows = with_interval(rows, source.calendar, "startDate", "completeDate", mode=mode)
    columns = _order_columns() | {
        "T_projectType": text.default_for_null(F.col("T_projecttype"), "None"),
        "orderClassType": text.default_for_null(F.col("orderclasstype"), "None"),
        "orderType": text.default_for_null(F.col("ordertype"), "None"),
        "orderDescription": text.default_for_null(F.col("orderDescription"), "None"),
        "Expedite": text.default_for_empty(F.col("Expedite"), "N"),
    }
    del columns["T_projecttype"]
    return rows.where(F.col(DAYS) >= 0).select(
        "orderID", "subIntID", "subIntervalName", "owner", "PID", "phaseName", "sourceSystem",
        F.col("startDate").alias("startdate"), F.col("completeDate").alias("completedate"), DAYS,
        *_named(columns),
    ).distinct()


def extract_nonworkdays(calendar: DataFrame, *, from_year: int) -> DataFrame:
    """Dates that are not work days, from the given year on."""
    return calendar.where((F.col("isworkday") == 0) & (F.year("date") >= from_year)).select("date")


def extract_task_dictionary(source: Warehouse) -> DataFrame:
    """Names and phases of the task types that are not first-day tasks."""
    return task_types(source.dictionary, source.phases)
