"""Category codes as a table: the rank of each category of a feature by its number of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taskspan.sources.stage import stage

UNKNOWN = -1  # the code of missing and unseen categories
_PARTITION_BITS = 33  # of monotonically_increasing_id


def category_counts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows per feature and category; missing values are a category of their own."""
    pairs = F.explode(F.array(*(
        F.struct(F.lit(name).alias("feature"), F.col(name).cast("string").alias("category"))
        for name in features)))
    return df.select(pairs.alias("pair")).groupBy("pair.feature", "pair.category").agg(
        F.count(F.lit(1)).alias("rows"))


def category_dictionary(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, category, code) of all categories that occur, as a stored table.

    Codes go from 0, the most frequent category first, equally frequent ones in order of their text.
    The categories are dealt into ranges of that order, so a feature may have any number of them;
    only one row per range and feature meets in a window.
    """
    counts = category_counts(train, features).where(F.col("category").isNotNull())
    order = ["feature", F.col("rows").desc(), "category"]
    parts = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stage(
        stage(counts, "category-counts").repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .withColumn("place", F.monotonically_increasing_id()), "category-places",
    ).withColumn("range", F.shiftright("place", _PARTITION_BITS))
    ranges = placed.groupBy("feature", "range").agg(
        F.min("place").alias("first"), F.count(F.lit(1)).alias("categories"))
    earlier = Window.partitionBy("feature").orderBy("range")
    ranges = ranges.withColumn("before", F.sum("categories").over(earlier) - F.col("categories"))
    return stage(placed.join(stage(ranges, "category-ranges"), ["feature", "range"]).select(
        "feature", "category",
        (F.col("place") - F.col("first") + F.col("before")).cast("int").alias("code")), "dictionary")


def dictionary_sizes(dictionary: DataFrame, features: Sequence[str]) -> list[int]:
    """Categories per feature."""
    sizes = {r["feature"]: r["n"] for r in dictionary.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n")).collect()}  # one row per feature
    return [sizes.get(name, 0) for name in features]


def encode(df: DataFrame, dictionary: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add `<feature>_index` with the code of each feature, UNKNOWN for missing and unseen values.

    `dictionary` is stored, so the planner broadcasts a small one by its own size check.
    """
    for name in features:
        codes = dictionary.where(F.col("feature") == name).select(
            F.col("category").alias("_category"), F.col("code").alias(f"{name}_index"))
        df = df.join(codes, F.col(name).cast("string") == F.col("_category"), "left").drop(
            "_category").withColumn(f"{name}_index", F.coalesce(f"{name}_index", F.lit(UNKNOWN)))
    return df
