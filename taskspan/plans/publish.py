"""The whole batch: every table of the pipeline, written in order, each step reading the one before.

Tables go to new folders, are checked and then take the place of those before, in the list of
publications and, with a database, in the catalog. The written tables take the
place of the stored stages, so a later step never recomputes an earlier one. Stages that a step
needs on the way are deleted when it ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskspan.operators import configs
from taskspan.operators.boost import (
    QuantileBoost, fit_quantile_boost, log_run, round_scores, run_record, scored_table,
)
from taskspan.operators.extract import extract_task_dictionary
from taskspan.operators.metrics import eval_metrics
from taskspan.operators.rework import missing_columns, rework_merge
from taskspan.plans.prepare import binned_stages, prepare_test, rare_order_categories
from taskspan.schema import DAYS, TASK_COLUMNS
from taskspan.sources.stage import run_stages, stage
from taskspan.sources.tables import Publications, Warehouse

# Rows of the published tables that cannot be right.
_CHECKS = {
    "train_data": {"at least one day": f"{DAYS} >= 1"},
    "merged_tasks": {"with a count": "count >= 1"},
}


class Publisher(Publications):
    """Writes named tables under a folder and, with a database, registers them."""

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Publish a table with the checks that belong to its name."""
        return self.publish(name, df, _CHECKS.get(name))


def publish_tables(source: Warehouse, publisher: Publisher, *, train_window: tuple[str, str],
                   test_window: tuple[str, str], from_year: int,
                   **options) -> dict[str, DataFrame]:
    """Write the training, statistics and test tables and return them by name.

    `options` are those of `train_stages`; its date lists are stored with the merged tasks. With
    `mode="repaired"` the test rows get the rare categories of the training orders binned too.
    """
    with run_stages(source.tasks.sparkSession):
        merge = {k: options.pop(k) for k in ("recompute_singles", "form") if k in options}
        mode = options.get("mode", "faithful")
        stages = binned_stages(source, window=train_window, **options)
        tables = {"preprocessed_tasks": publisher.write("preprocessed_tasks", stages["thresholded"])}
        binned = publisher.write("binned_tasks", stages["binned"])
        merged = publisher.write("merged_tasks", rework_merge(
            binned, source.calendar, from_year=from_year,
            nullable=missing_columns(binned, TASK_COLUMNS), **merge))
        train = publisher.write("train_data", configs.train_table(merged))
        stats = publisher.write("train_stats", configs.config_stats_named(
            configs.config_stats(train), extract_task_dictionary(source)))
        rare = rare_order_categories(source, window=train_window, mode=mode)
        test = publisher.write("test_data", prepare_test(
            source, window=test_window, mode=mode, rare=rare if mode == "repaired" else None))
        return tables | {"binned_tasks": binned, "merged_tasks": merged, "train_data": train,
                         "train_stats": stats, "test_data": test}


def publish_model(tables: dict[str, DataFrame], publisher: Publisher,
                  **settings) -> tuple[QuantileBoost, DataFrame]:
    """Fit on the train table, score the test table, save the model and log the run.

    Every run has a model folder of its own, which its row in the run table names. Returns the model
    and the run table. Metrics are taken before the predictions are rounded.
    """
    train, test = tables["train_data"], tables["test_data"]
    with run_stages(train.sparkSession):
        model = fit_quantile_boost(train, **settings)
        scored = stage(scored_table(model, test, rounded=False), "scored")
        publisher.write("scored_data", round_scores(scored))
        path = model.save(train.sparkSession, f"{publisher.folder}/models/{uuid.uuid4().hex}")
        record = run_record(model.settings, eval_metrics(scored), path)
        return model, log_run(record, f"{publisher.folder}/runs")


def published_counts(spark: SparkSession, publisher: Publisher) -> DataFrame:
    """Rows per published table, as counted while it was written."""
    return publisher.present(spark).select(F.col("table").alias("stage"), "rows")
