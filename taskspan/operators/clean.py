"""Cleaning steps shared by the task and order extracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskspan.functions.numbers import at_least_one_day
from taskspan.functions.text import recode
from taskspan.schema import BOOLEAN_NAMES, DAYS, EXPEDITE_NAMES, ORDER_ACTION_NAMES, TASK_COLUMNS

_RECODES = {
    "orderAction": ORDER_ACTION_NAMES,
    "isBuildingAdd": BOOLEAN_NAMES,
    "is3rdpartycoloneeded": BOOLEAN_NAMES,
    "Expedite": EXPEDITE_NAMES,
}


def drop_negative(df: DataFrame, column: str = DAYS) -> DataFrame:
    """Keep intervals of zero or more days; missing intervals drop."""
    return df.where(F.col(column) >= 0)


def clean(df: DataFrame, *, interval_col: str = DAYS) -> DataFrame:
    """Drop negative intervals, count same-day work as one day and unify spellings."""
    recoded = {name: recode(F.col(name), names) for name, names in _RECODES.items()}
    return drop_negative(df, interval_col).withColumns(
        {interval_col: at_least_one_day(F.col(interval_col)), **recoded})


def task_table(df: DataFrame) -> DataFrame:
    """The columns of a task table, in order and in their stored spelling."""
    return df.select(*(F.col(name).alias(name) for name in TASK_COLUMNS))


def split_by_jeop(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Task rows without and with a dependency code."""
    return df.where(F.col("taskJeop") == "None"), df.where(F.col("taskJeop") != "None")


def append_rows(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, by column name; a column a part lacks is missing there."""
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result


def add_cancelled(tasks: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Append the cancelled dependency rows to the task table, same-day work as one day."""
    extra = cancelled.withColumns({
        DAYS: at_least_one_day(F.col(DAYS)),
        "isBuildingAdd": recode(F.col("isBuildingAdd"), BOOLEAN_NAMES),
    })
    return append_rows(tasks, task_table(extra))
