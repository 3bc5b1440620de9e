"""Options of the two pipelines, checked by counts and invariants."""

import pytest
from pyspark.sql import functions as F

from taskspan.operators.clean import clean
from taskspan.operators.extract import extract_cancelled_dependency
from taskspan.operators.rework import missing_columns
from taskspan.plans import prepare
from taskspan.schema import DAYS, TASK_COLUMNS
from taskspan.sources import mapping

SF = "/root/testdata/sf0.01"
OPTIONS = {"window": mapping.TRAIN_WINDOW, "from_year": mapping.NONWORK_FROM_YEAR}


@pytest.fixture(scope="module")
def big_source(spark):
    return mapping.warehouse(spark, SF)


@pytest.fixture(scope="module")
def stages(big_source):
    found = prepare.train_stages(big_source, **OPTIONS)
    return {name: df.cache() for name, df in found.items()}


def test_trim_drops_a_tenth_of_each_task(stages):
    sizes = stages["cleaned"].groupBy("subIntervalName").agg(F.count(DAYS).alias("n"))
    left = stages["trimmed"].groupBy("subIntervalName").agg(F.count(DAYS).alias("left"))
    wrong = sizes.join(left, "subIntervalName", "left").where(
        F.coalesce("left", F.lit(0))
        != F.when(F.col("n") < 10, 0).otherwise(F.col("n") - F.floor(F.col("n") / 10)))
    assert wrong.isEmpty()


def test_stage_counts_agree(stages):
    counts = {name: df.count() for name, df in stages.items()}
    assert counts["extracted"] >= counts["cleaned"] >= counts["trimmed"]
    assert counts["binned"] == counts["thresholded"]
    assert stages["merged"].agg(F.sum("count")).first()[0] == counts["binned"]
    assert counts["extracted"] == 6113


def test_default_leaves_no_value_missing(stages):
    assert missing_columns(stages["extracted"], TASK_COLUMNS) == []


def test_train_options(big_source, stages):
    base = stages["merged"].count()
    kept = prepare.train_stages(big_source, keep_small=True, **OPTIONS)
    assert kept["trimmed"].count() > stages["trimmed"].count()
    repaired = prepare.train_stages(big_source, mode="repaired", **OPTIONS)
    assert repaired["trimmed"].count() > stages["trimmed"].count()
    assert repaired["thresholded"].count() <= repaired["trimmed"].count()  # no repeated rows
    cancelled = extract_cancelled_dependency(big_source, window=mapping.TRAIN_WINDOW)
    more = prepare.train_stages(big_source, include_cancelled=True, form="counts", **OPTIONS)
    assert more["binned"].count() == stages["binned"].count() + cancelled.count()
    assert more["merged"].count() > base


def test_cancelled_rows_keep_missing_marks(big_source):
    cancelled = extract_cancelled_dependency(big_source, window=mapping.TRAIN_WINDOW)
    assert "Expedite" in missing_columns(cancelled, cancelled.columns)


def test_test_rows_keep_every_dependency_task(big_source):
    got = prepare.prepare_test(big_source, window=mapping.TEST_WINDOW).cache()
    assert tuple(got.columns) == TASK_COLUMNS
    rare = prepare.rare_order_categories(big_source, window=mapping.TRAIN_WINDOW)
    binned = prepare.prepare_test(big_source, window=mapping.TEST_WINDOW, rare=rare)
    assert binned.count() == got.count()
    assert binned.where("categoryCD = 'Others'").count() > 0
    assert got.where("categoryCD = 'Others'").isEmpty()


def test_clean_is_stable(stages):
    again = clean(stages["cleaned"])
    assert again.exceptAll(stages["cleaned"]).isEmpty()
    assert again.count() == stages["cleaned"].count()
