"""Time the headline pipelines and print one JSON line.

BENCH_SF_DIR picks the tables (default sf0.1), BENCH_CPUS the local cores. Each query runs twice in
one session, from the source tables to a sink that discards the rows, and the better time counts:
the first run of a session pays for code generation and class loading. Nothing is kept between runs
but the three small dimension tables.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from taskspan.operators import boost
from taskspan.plans import queries
from taskspan.session import local_session
from taskspan.sources import mapping
from taskspan.sources.stage import stage

RUNS = 2
BOOST_ROUNDS = 10
HEADLINE = (
    "extract_tasks", "extract_tasks_original", "trim_bottom", "threshold_outliers",
    "bin_rare_categories", "rework_merge", "rework_days", "prepare_train", "prepare_test",
    "config_stats_named", "quantile_lookup", "eval_metrics",
)


def discard(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def best_time(run: Callable[[], None], runs: int = RUNS) -> float:
    times = []
    for _ in range(runs):
        start = time.perf_counter()
        run()
        times.append(time.perf_counter() - start)
    return round(min(times), 3)


def boosting_round(spark: SparkSession, sf_dir: str) -> float:
    """Seconds per boosting round, encoding and summing up the training rows included."""
    train = stage(queries.QUERIES["train_table"](spark, sf_dir), "train")
    start = time.perf_counter()
    boost.fit_quantile_boost(train, rounds=BOOST_ROUNDS)
    return round((time.perf_counter() - start) / BOOST_ROUNDS, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, "taskspan-bench")
    discard(mapping.warehouse(spark, sf_dir).tasks)
    seconds = {
        name: best_time(lambda name=name: discard(queries.QUERIES[name](spark, sf_dir)))
        for name in HEADLINE
    }
    seconds["boosting_round"] = boosting_round(spark, sf_dir)
    print(json.dumps({
        "metric": "headline queries, total wall time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cores": cores,
        "spark": spark.version,
        "runs": RUNS,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
