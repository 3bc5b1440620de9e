"""Rare categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskspan.schema import MIN_CATEGORY_ORDERS, RARE_LABEL
from taskspan.sources.stage import stage


def rare_categories(orders: DataFrame, *, col: str = "categoryCD", key: str = "orderID",
                    min_orders: int = MIN_CATEGORY_ORDERS,
                    where: Column | None = None) -> DataFrame:
    """Categories with fewer than `min_orders` orders among the rows that pass `where`.

    By default only CORE orders count; a category that no CORE order has is not rare.
    """
    counted = orders.where(F.col("sourceSystem") == "CORE" if where is None else where)
    return (
        counted.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(key).alias("orders"))
        .where(F.col("orders") < min_orders)
    )


def bin_rare(df: DataFrame, rare: DataFrame, *, col: str = "categoryCD",
             label: str = RARE_LABEL) -> DataFrame:
    """Replace the rare categories in rows of any source system."""
    marked = stage(rare.select(col), "rare-categories").withColumn("_rare", F.lit(True))
    binned = F.when(F.col("_rare"), F.lit(label)).otherwise(F.col(col))
    return df.join(marked, col, "left").withColumn(col, binned).select(*df.columns)
