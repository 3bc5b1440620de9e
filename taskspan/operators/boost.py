"""Quantile regression by boosted decision trees.

The predictors are categories and the label is whole days, so the training rows are first summed up
into weighted distinct rows. Every round grows a tree leaf by leaf on the gradient of the quantile
loss (`trees`) and sets each leaf to the exact quantile of its residuals.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskspan.functions.numbers import round_half_even
from taskspan.operators import trees
from taskspan.operators.dictionary import (
    category_counts, category_dictionary, dictionary_sizes, encode,
)
from taskspan.operators.quantiles import group_quantiles
from taskspan.operators.stats import interval_stats
from taskspan.schema import DAYS, FEATURES
from taskspan.sources.stage import stage

QUANTILE = 0.75
ROUNDS = 300
RATE = 0.1
LEAVES = 128
MAX_DEPTH = 12
MIN_LEAF = 20
_STORE_EVERY, _STORE_SPREAD = 100, 25  # rounds of one task, and of many


def unseen_categories(train: DataFrame, test: DataFrame,
                      features: Sequence[str] = FEATURES) -> DataFrame:
    """Test rows per feature and category that the training rows lack."""
    return category_counts(test, features).join(
        category_counts(train, features).drop("rows"), ["feature", "category"], "left_anti")


@dataclass
class QuantileBoost:
    """A fitted model: stored category dictionary, starting value and one tree per round.

    `settings` has what the model was fitted with.
    """

    dictionary: DataFrame
    features: Sequence[str]
    base: float
    rate: float
    alpha: float
    rounds: list[trees.Tree] = field(default_factory=list)
    settings: dict[str, float] = field(default_factory=dict)

    def leaf_table(self, spark: SparkSession) -> DataFrame:
        """Leaf values as rows; leaves are numbered like the nodes of their tree."""
        rows = [(i, leaf, float(value)) for i, tree in enumerate(self.rounds)
                for leaf, value in sorted(tree.values.items())]
        return spark.createDataFrame(rows, "round int, leaf int, value double")

    def split_table(self, spark: SparkSession) -> DataFrame:
        """The cuts as rows; `left_codes` has a bit per code of the feature."""
        rows = [(i, node, s.feature, np.packbits(s.left).tobytes(), len(s.left), s.low, s.high)
                for i, tree in enumerate(self.rounds) for node, s in sorted(tree.splits.items())]
        return spark.createDataFrame(
            rows, "round int, node int, feature int, left_codes binary, codes int, low int, high int")

    def predict(self, df: DataFrame, name: str = "Prediction") -> DataFrame:
        """Add the prediction.

        Every distinct combination of categories is scored once, by all trees in one pass, and the
        scores are joined back to the rows. The broadcast model is as bounded as its settings.
        `df` is read twice, and all conditions of its plan would be repeated for every category that
        is renamed, which can fill the planner's heap: pass a stored table.
        """
        if not self.rounds:
            return df.withColumn(name, F.lit(self.base))
        features, base, rate = list(self.features), self.base, self.rate
        sizes = dictionary_sizes(self.dictionary, features)
        forest = df.sparkSession.sparkContext.broadcast(self.rounds)
        combinations = df.select(*features).distinct()
        coded = encode(combinations, self.dictionary, features).select(
            *(F.col(c).alias(f"_of_{c}") for c in features), *(f"{c}_index" for c in features))
        kept = T.StructType([*coded.schema.fields[:len(features)], T.StructField(name, T.DoubleType())])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[len(features):]]
                codes = np.array([np.where(c < 0, n, c) for c, n in zip(columns, sizes)], np.int32)
                total = np.full(batch.num_rows, base)
                for tree in forest.value:
                    total = total + rate * tree.scores(codes)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:len(features)], pa.array(total)], names=kept.names)

        scores = coded.mapInArrow(score, kept)
        same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in features]
        return df.join(scores, same).select(*df.columns, name)

    def save(self, spark: SparkSession, path: str) -> str:
        """Write dictionary, cuts and leaf values under `path`."""
        self.dictionary.write.mode("overwrite").parquet(f"{path}/dictionary")
        self.split_table(spark).write.mode("overwrite").parquet(f"{path}/splits")
        self.leaf_table(spark).write.mode("overwrite").parquet(f"{path}/leaves")
        spark.createDataFrame(
            [(self.base, self.rate, self.alpha, len(self.rounds), list(self.features), self.settings)],
            "base double, rate double, alpha double, rounds int, features array<string>, "
            "settings map<string, double>",
        ).write.mode("overwrite").parquet(f"{path}/settings")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "QuantileBoost":
        """Read a saved model."""
        settings = spark.read.parquet(f"{path}/settings").first()
        rounds = [trees.Tree() for _ in range(settings["rounds"])]
        for row in spark.read.parquet(f"{path}/splits").collect():  # the model itself
            bits = np.unpackbits(np.frombuffer(row["left_codes"], np.uint8), count=row["codes"])
            rounds[row["round"]].splits[row["node"]] = trees.Split(
                row["feature"], bits.astype(bool), row["low"], row["high"])
        for row in spark.read.parquet(f"{path}/leaves").collect():
            rounds[row["round"]].values[row["leaf"]] = row["value"]
        return cls(spark.read.parquet(f"{path}/dictionary"), settings["features"], settings["base"],
                   settings["rate"], settings["alpha"], rounds, settings["settings"])


def start_value(train: DataFrame, *, label: str = DAYS, alpha: float = QUANTILE) -> float:
    """The quantile of all rows, where boosting starts."""
    return interval_stats(train, [], value=label, percentiles={"q": alpha}).first()["q"]


def gradient(actual: Column, score: Column, alpha: float = QUANTILE) -> Column:
    """Negative gradient of the quantile loss at the running score."""
    return F.when(actual > score, F.lit(alpha)).otherwise(F.lit(alpha - 1.0))


def leaf_quantiles(rows: DataFrame, *, leaf: str, residual: Column, weight: Column | None = None,
                   alpha: float = QUANTILE, decimals: int | None = None) -> DataFrame:
    """The alpha-quantile of the residuals per leaf, as `value`; exact unless `decimals` are given.

    Equal residuals are added up first; no task holds the residuals of a leaf.
    """
    residual = residual if decimals is None else F.round(residual, decimals)
    counted = rows.groupBy(leaf, residual.alias("residual")).agg(
        F.sum(F.lit(1) if weight is None else weight).alias("weight"))
    return group_quantiles(counted, [leaf], "residual", alpha, weight="weight", name="value")


def fit_quantile_boost(train: DataFrame, *, features: Sequence[str] = FEATURES, label: str = DAYS,
                       alpha: float = QUANTILE, rounds: int = ROUNDS, rate: float = RATE,
                       leaves: int = LEAVES, max_depth: int = MAX_DEPTH,
                       min_leaf: int = MIN_LEAF, task_rows: int = trees.TASK_ROWS) -> QuantileBoost:
    """Fit the model; `min_leaf` is in training rows.

    Up to `task_rows` cells one task holds them all and fits many rounds in one job; beyond that they are
    spread over tasks, and a round is some jobs. Every so many rounds the cells are written to the shared
    folder with their scores, so a lost executor costs no more than these. The model does not depend
    on the number of tasks.
    """
    dictionary = category_dictionary(train, features)
    sizes = dictionary_sizes(dictionary, features)
    base = start_value(train, label=label, alpha=alpha)
    model = QuantileBoost(dictionary, tuple(features), base, rate, alpha, settings={
        "alpha": float(alpha), "rounds": float(rounds), "rate": float(rate), "leaves": float(leaves),
        "max_depth": float(max_depth), "min_leaf": float(min_leaf)})
    weighted = stage(train.groupBy(*features, label).agg(F.count(F.lit(1)).alias("_weight")), "distinct-rows")
    cells = stage(encode(weighted, dictionary, features).select(
        *(f"{c}_index" for c in features), label, "_weight", F.lit(base).alias("_score")), "cells")
    count = cells.count()
    alone = count < task_rows
    blocks = stage(trees.packed(
        cells if alone else cells.coalesce(1 + count // min(task_rows, trees.SPREAD_ROWS)), sizes), "blocks")
    options = {"alpha": alpha, "leaves": leaves, "max_depth": max_depth, "min_leaf": min_leaf}
    while len(model.rounds) < rounds:
        ahead = min(_STORE_EVERY if alone else _STORE_SPREAD, rounds - len(model.rounds))
        if alone:
            grown = trees.told(blocks.coalesce(1), sizes, lambda part, n=ahead: trees.fitted_in_a_row(
                part, sizes, n, rate, **options))
        else:
            grown = _spread_rounds(blocks, sizes, ahead, rate, options)
        model.rounds += grown
        if len(model.rounds) < rounds:
            blocks = stage(trees.rescored(blocks, sizes, grown, rate), "blocks")
    return model


def _spread_rounds(blocks: DataFrame, sizes: Sequence[int], rounds: int, rate: float, options: dict
                   ) -> list[trees.Tree]:
    """Rounds over blocks on many executors, which keep them, with their scores, between the jobs."""
    grown, held = [], [blocks.persist(StorageLevel.MEMORY_AND_DISK)]
    for _ in range(rounds):
        grown.append(trees.fitted(trees.Spread(held[-1], sizes), sizes, **options))
        if len(held) > 1:  # the blocks no longer need what they are made from
            held.pop(0).unpersist()
        held.append(trees.rescored(held[-1], sizes, grown[-1:], rate).persist(StorageLevel.MEMORY_AND_DISK))
    for one in held:
        one.unpersist()
    return grown


def round_scores(scored: DataFrame, name: str = "Prediction") -> DataFrame:
    """Predictions as whole days, halves to the even neighbour."""
    return scored.withColumn(name, round_half_even(F.col(name)))


def scored_table(model: QuantileBoost, test: DataFrame, *, label: str = DAYS,
                 rounded: bool = True) -> DataFrame:
    """Order, predictors, actual and predicted days. Metrics belong on unrounded predictions."""
    scored = model.predict(test.select("orderID", *FEATURES, F.col(label).alias("Actual")))
    return round_scores(scored) if rounded else scored


RUN_SCHEMA = """logged_at timestamp, model_path string, settings map<string, double>, n long,
    rmse double, mae double, r2 double, median_ae double"""


def run_record(settings: dict[str, float], metrics: DataFrame, model_path: str) -> DataFrame:
    """One row with the parameters, the metrics and the place of the model."""
    pairs = [F.lit(x) for name, value in settings.items() for x in (name, float(value))]
    return metrics.select(
        F.current_timestamp().alias("logged_at"),
        F.lit(model_path).alias("model_path"),
        F.create_map(*pairs).cast("map<string, double>").alias("settings"),
        *metrics.columns,
    )


def log_run(record: DataFrame, path: str) -> DataFrame:
    """Append a run record to the run table at `path` and return the table.

    The columns are the same for every run: settings are a map, so runs may differ in them.
    """
    record.write.mode("append").parquet(path)
    return record.sparkSession.read.schema(RUN_SCHEMA).parquet(path)
