"""Source tables laid out by month, so that an extract of a window reads that window's files.

Orders are partitioned by the month in which they were completed. Attributes and tasks have no such
date of their own; they are partitioned by the month of their order. Months are counted from year 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskspan.sources.stage import stage
from taskspan.sources.tables import Warehouse, overwrite_table

MONTH = "completeMonth"  # of an order
ORDER_MONTH = "orderMonth"  # of the order that a row belongs to
UNDATED = 0  # orders without a date of completion, and their rows
SEVERAL = -1  # rows of a key whose orders are in several months
ORDERLESS = -2  # rows of a key without orders

_SORTED = {"orders": "completedate", "attributes": "sourcekey", "tasks": "completeDate"}


def month_of(moment: Column) -> Column:
    """Month of a date or a time."""
    return (F.year(moment) * 12 + F.month(moment)).cast("int")


def months_of_keys(orders: DataFrame) -> DataFrame:
    """`sourcekey` and the month in which its orders are, or SEVERAL; keys that are missing drop."""
    return orders.where(F.col("sourcekey").isNotNull()).groupBy("sourcekey").agg(
        F.min(MONTH).alias("_low"), F.max(MONTH).alias("_high")
    ).select("sourcekey", F.when(F.col("_low") == F.col("_high"), F.col("_low"))
             .otherwise(SEVERAL).cast("int").alias(ORDER_MONTH))


def by_month(source: Warehouse) -> Warehouse:
    """The same rows with the columns that `write_by_month` partitions by.

    Attributes and tasks meet the stored months of the orders; a key that holds a large share of the
    tasks is split by the adaptive join.
    """
    dated = source.orders.withColumn(
        MONTH, F.coalesce(month_of(F.col("completedate")), F.lit(UNDATED)))
    months = stage(months_of_keys(dated), "order-months")

    def placed(df: DataFrame) -> DataFrame:
        return df.join(months, "sourcekey", "left").withColumn(
            ORDER_MONTH, F.coalesce(ORDER_MONTH, F.lit(ORDERLESS)))

    return source._replace(
        orders=dated, attributes=placed(source.attributes), tasks=placed(source.tasks))


def write_by_month(source: Warehouse, folder: str) -> Warehouse:
    """Write the six source tables under a folder, the three large ones by month, and read them back.

    A month is dealt to as many tasks as its size asks for, and its rows are sorted by date, so that
    the statistics of the files prune within it. Attributes and tasks follow the months of the orders
    they are written with: write all three anew when orders change.
    """
    for name, df in by_month(source)._asdict().items():
        if name not in _SORTED:
            overwrite_table(df, f"{folder}/{name}")
            continue
        column = MONTH if name == "orders" else ORDER_MONTH
        dealt = df.hint("rebalance", column).sortWithinPartitions(column, _SORTED[name])
        overwrite_table(dealt, f"{folder}/{name}", partition_by=[column])
    return read_by_month(source.orders.sparkSession, folder)


def read_by_month(spark: SparkSession, folder: str) -> Warehouse:
    """The tables that `write_by_month` wrote."""
    return Warehouse(**{
        name: spark.read.parquet(f"{folder}/{name}") for name in Warehouse._fields}).checked()


def in_months(orders: DataFrame, window: tuple[str, str]) -> DataFrame:
    """Orders in the months of a window, if they are laid out by month; the rest is not read."""
    if MONTH not in orders.columns:
        return orders
    first, last = (month_of(F.to_date(F.lit(day))) for day in window)
    return orders.where(F.col(MONTH).between(first, last))


def beside(df: DataFrame, orders: DataFrame) -> DataFrame:
    """Attributes or tasks that may belong to one of the orders, if both are laid out by month.

    The months of the orders reach the scan by dynamic partition pruning; there are as many of them
    as the calendar has, so they are broadcast. `orders` is read for it: pass a stored table.
    """
    if ORDER_MONTH not in df.columns or MONTH not in orders.columns:
        return df.drop(ORDER_MONTH)
    # the condition holds for every order; it tells the planner that this side selects
    months = orders.where(F.col(MONTH) >= UNDATED).select(
        F.explode(F.array(F.col(MONTH), F.lit(SEVERAL))).alias(MONTH)).distinct()
    return df.join(
        F.broadcast(months), F.col(ORDER_MONTH) == F.col(MONTH), "left_semi").drop(ORDER_MONTH)
