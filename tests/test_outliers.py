import random
from fractions import Fraction
from math import floor

import pytest
from pyspark.sql import functions as F

from taskspan.functions.numbers import category_threshold, p99_category
from taskspan.operators import categories, outliers, stats
from taskspan.schema import DAYS

TASK = "subIntervalName"


def tasks(spark, sizes, value=lambda i: i):
    rows = [(name, i, value(i)) for name, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, f"{TASK} string, id int, {DAYS} int")


def kept(df):
    return {r[TASK]: r["n"] for r in df.groupBy(TASK).agg(F.count("*").alias("n")).collect()}


SIZES = {"nine": 9, "ten": 10, "eleven": 11, "twenty": 20}


@pytest.mark.parametrize("value", [lambda i: i, lambda i: 1, lambda i: i // 7])
def test_trim_bottom_boundaries(spark, value):
    df = tasks(spark, SIZES, value)
    assert kept(outliers.trim_bottom(df)) == {"ten": 9, "eleven": 10, "twenty": 18}
    assert kept(outliers.trim_bottom(df, keep_small=True))["nine"] == 9


@pytest.mark.parametrize("value", [lambda i: i, lambda i: 1, lambda i: i // 7])
def test_trim_both_boundaries(spark, value):
    got = kept(outliers.trim_both(tasks(spark, SIZES, value)))
    assert got == {"nine": 9, "ten": 10, "eleven": 8, "twenty": 16}


def test_trim_both_keeps_the_middle_ranks(spark):
    got = outliers.trim_both(tasks(spark, {"a": 11}))
    assert sorted(r[DAYS] for r in got.collect()) == list(range(1, 9))


@pytest.mark.parametrize("frac", [0.0, 0.15, 0.3, 0.4, 0.49, 0.125])
def test_trim_both_cuts_any_fraction_exactly(spark, frac):
    got = outliers.trim_both(tasks(spark, {"a": 20}), frac=frac)
    part = Fraction(str(frac))
    want = list(range(floor(20 * part), floor(20 * (1 - part))))
    assert sorted(r[DAYS] for r in got.collect()) == want


@pytest.mark.parametrize("frac", [0.0004, 0.15, 0.3, 0.4])
def test_trim_bottom_cuts_any_fraction_exactly(spark, frac):
    got = outliers.trim_bottom(tasks(spark, {"a": 10_000}), frac=frac)
    assert sorted(r[DAYS] for r in got.collect())[0] == floor(10_000 * Fraction(str(frac)))
    assert got.count() == 10_000 - floor(10_000 * Fraction(str(frac)))


@pytest.mark.parametrize("frac", [-0.1, 0.5, 1])
def test_fractions_that_leave_nothing_are_errors(spark, frac):
    with pytest.raises(ValueError):
        outliers.trim_both(tasks(spark, {"a": 20}), frac=frac)


def test_trim_matches_a_full_sort(spark):
    """Skewed, tied, with copies and missing values: the rows a row-by-row ranking keeps."""
    rng = random.Random(7)
    rows = [("hot", rng.randint(0, 50), rng.choice([1, 1, 1, 2, 3, 30])) for _ in range(3000)]
    rows += [(f"t{i % 9}", i, rng.randint(0, 4)) for i in range(700)]
    rows += [("copies", 1, 5)] * 500 + [("copies", 2, 5)] * 3 + [(None, 1, 1)] * 20
    rows += [("t1", 1, None)] * 30
    df = spark.createDataFrame(rows, f"{TASK} string, id int, {DAYS} int").cache()
    df.createOrReplaceTempView("trim_rows")
    ranked = f"""
      select *, row_number() over (partition by {TASK} order by {DAYS} nulls last,
          md5(concat_ws('|', {TASK}, id, {DAYS}))) as rn,
        count({DAYS}) over (partition by {TASK}) as n, count(*) over (partition by {TASK}) as m
      from trim_rows where {TASK} is not null"""
    bottom = spark.sql(f"select {TASK}, id, {DAYS} from ({ranked}) where n >= 10 and rn > n div 10")
    both = spark.sql(f"select {TASK}, id, {DAYS} from ({ranked}) "
                     "where m <= 10 or rn > m div 10 and rn <= 9 * m div 10")
    for got, want in ((outliers.trim_bottom(df), bottom), (outliers.trim_both(df), both)):
        assert got.count() == want.count()
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_trim_ranks_no_task_as_a_whole(spark):
    """The only row-level window runs inside a slice of tied rows."""
    plan = outliers.trim_bottom(tasks(spark, SIZES))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_slice" in line for line in windows)


def test_p99_buckets(spark):
    df = spark.createDataFrame(
        [(10.0,), (10.5,), (30.0,), (30.5,), (90.0,), (90.5,), (None,)], "p double")
    got = df.withColumn("c", p99_category(F.col("p"))).withColumn(
        "t", category_threshold(F.col("c")))
    assert [(r["c"], r["t"]) for r in got.collect()] == [
        ("0-10", 30), ("11-30", 90), ("11-30", 90), ("31-90", 180), ("31-90", 180), ("90+", 360),
        (None, None)]


def test_thresholds_by_name_repeat_shared_names(spark):
    rows = [("a", i, 5) for i in (1, 2) for _ in range(10)] + [("b", 3, 200)] * 10 + [("b", 3, 400)]
    df = spark.createDataFrame(rows, f"{TASK} string, subIntID int, {DAYS} int")
    by_name = outliers.threshold_outliers(df)
    assert kept(by_name) == {"a": 40, "b": 10}
    by_id = outliers.threshold_outliers(df, join_keys=(TASK, "subIntID"))
    assert kept(by_id) == {"a": 20, "b": 10}


def test_tasks_with_rows(spark):
    assert kept(outliers.tasks_with_rows(tasks(spark, SIZES))) == {
        "ten": 10, "eleven": 11, "twenty": 20}


def test_rare_categories_count_core_only(spark):
    rows = [("CORE", "big", str(i)) for i in range(100)] + [("CORE", "small", "x")]
    rows += [("BPM-QS", "elsewhere", "y"), ("CORE", None, "z")]
    orders = spark.createDataFrame(rows, "sourceSystem string, categoryCD string, orderID string")
    rare = categories.rare_categories(orders)
    assert [tuple(r) for r in rare.collect()] == [("small", 1)]
    df = spark.createDataFrame(
        [("small",), ("elsewhere",), ("big",), (None,)], "categoryCD string")
    assert sorted(str(r[0]) for r in categories.bin_rare(df, rare).collect()) == [
        "None", "Others", "big", "elsewhere"]


def test_interval_stats_match_direct_aggregates(spark):
    rng = random.Random(3)
    rows = [("a", rng.randint(0, 40)) for _ in range(500)] + [("b", 7), ("c", None)]
    df = spark.createDataFrame(rows, f"k string, {DAYS} int").cache()
    want = df.groupBy("k").agg(
        F.count(DAYS), F.avg(DAYS), F.stddev(DAYS), F.min(DAYS),
        *(F.percentile(DAYS, p) for p in stats.TASK_PERCENTILES.values()), F.max(DAYS))
    got = {r[0]: tuple(r)[1:] for r in stats.interval_stats(df, ["k"]).collect()}
    for row in want.collect():
        assert got[row[0]] == pytest.approx(tuple(row)[1:], nan_ok=True)


def test_interval_stats_round_halves_up(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1)], f"k string, {DAYS} int")
    assert stats.interval_stats(df, ["k"], round_to=0).first()["mean"] == 1.0


def test_interval_stats_want_whole_days(spark):
    df = spark.createDataFrame([("a", 0.5)], f"k string, {DAYS} double")
    with pytest.raises(TypeError):
        stats.interval_stats(df, ["k"])


def test_counts(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "c string")
    assert [tuple(r) for r in stats.value_counts(df, "c").collect()] == [("x", 2), ("y", 1)]
    assert stats.n_unique(df, "c").first()[0] == 2
    assert stats.n_unique(df, "c", approximate=True).first()[0] == 2
    assert [tuple(r) for r in stats.audit({"a": df, "b": df.limit(1)}).collect()] == [
        ("a", 4), ("b", 1)]
