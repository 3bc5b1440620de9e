"""Statistics from merged histograms, back-off quantiles and counts taken as the rows pass."""

import random

import pytest
from pyspark.sql import functions as F

from taskspan.operators import stats
from taskspan.schema import DAYS
from taskspan.sources.stage import counted, counted_rows, stage

SCHEMA = f"k string, t int, {DAYS} int, half int"


@pytest.fixture(scope="module")
def rows(spark):
    """A hot group with two thirds of the rows, missing keys and days, a group in one half only."""
    draw = random.Random(5)
    data = [(draw.choice(["hot", "hot", "a", None]), draw.choice([1, 2, None]),
             draw.choice([None, *range(40)]), draw.randrange(2)) for _ in range(900)]
    data += [("late", 3, 5, 1), ("none", 4, None, 0)]
    return spark.createDataFrame(data, SCHEMA).cache()


def same(a, b):
    return a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("keys", [["k", "t"], ["k"], []])
def test_merged_histograms_give_the_statistics_of_all_rows(rows, keys):
    parts = [stage(stats.histogram(rows.where(F.col("half") == h), keys), "half") for h in (0, 1)]
    whole = stats.interval_stats(rows, keys)
    assert same(stats.histogram_stats(stats.merge_histograms(parts, keys), keys), whole)
    again = stage(stats.merge_histograms(parts, keys), "state")  # a merged state is a state
    late = stage(stats.histogram(rows.where("k = 'late'"), keys), "late")
    both = stats.histogram_stats(stats.merge_histograms([again, late], keys), keys)
    assert same(both, stats.interval_stats(rows.unionAll(rows.where("k = 'late'")), keys))


def test_merging_an_empty_window_changes_nothing(rows):
    parts = [stats.histogram(df, ["k"]) for df in (rows, rows.limit(0))]
    assert same(stats.histogram_stats(stats.merge_histograms(parts, ["k"]), ["k"]),
                stats.interval_stats(rows, ["k"]))


def test_backoff_quantiles_equal_a_pass_per_level(rows):
    levels = [["k", "t"], ["t"], ["k"], []]
    found = stage(stats.backoff_quantiles(rows, levels, alpha=0.75), "levels")
    for number, keys in enumerate(levels):
        want = stats.interval_stats(rows, keys, percentiles={"quantile": 0.75})
        assert same(found.where(F.col("level") == number).select(*keys, "quantile"),
                    want.select(*keys, "quantile"))
    assert set(r.level for r in found.collect()) == {0, 1, 2, 3}


def test_backoff_levels_need_the_keys_of_the_first(rows):
    with pytest.raises(ValueError):
        stats.backoff_quantiles(rows, [["k"], ["t"]], alpha=0.5)


def test_rows_are_counted_as_they_are_written(spark, rows):
    with counted_rows() as found:
        first = stage(counted(rows, "all", days=F.col(DAYS) >= 0), "first")
        stage(counted(first.where("k = 'hot'"), "hot"), "second")
        stage(counted(first.where("k = 'gone'"), "gone"), "third")
    seen = {name: n for one in found.values() for name, n in one.get.items()}
    assert seen == {"all": rows.count(), "days": rows.where(f"{DAYS} >= 0").count(),
                    "hot": rows.where("k = 'hot'").count(), "gone": 0}


def test_steps_outside_are_not_marked(rows):
    assert counted(rows, "all") is rows
