from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from taskspan.functions import numbers, text
from taskspan.operators import clean, extract
from taskspan.schema import DAYS, SOURCE_SCHEMAS, TASK_COLUMNS, check_schema
from taskspan.sources.tables import Warehouse


def values(df):
    return [row[0] for row in df.collect()]


def test_blank_text_becomes_none(spark):
    df = spark.createDataFrame([(None,), ("",), ("   ",), ("Null",), ("x",)], "c string")
    got = values(df.select(text.default_for_blank(F.col("c"), "None", "Null")))
    assert got == ["None", "None", "None", "None", "x"]
    assert values(df.select(text.default_for_blank(F.col("c"), "None")))[3] == "Null"
    assert values(df.select(text.default_for_null(F.col("c"), "None"))) == [
        "None", "", "   ", "Null", "x"]
    assert values(df.select(text.default_for_empty(F.col("c"), "N"))) == [
        None, "N", "N", "Null", "x"]


def test_missing_values_fail_negative_tests(spark):
    df = spark.createDataFrame([(None,), ("None",), (" ",), ("INS",)], "orderAction string")
    assert values(df.where(text.has_text(F.col("orderAction")))) == ["INS"]
    tasks = spark.createDataFrame(
        [("N", None), ("N", 1), ("N", 0), ("Y", 0)], "deleteind string, isinserted int")
    assert extract.live_tasks(tasks).count() == 1


def test_recode_keeps_other_values(spark):
    df = spark.createDataFrame([("INS",), ("Grooms",), (None,)], "c string")
    assert values(df.select(text.recode(F.col("c"), {"INS": "Install"}))) == [
        "Install", "Grooms", None]


def test_key_is_missing_when_a_part_is(spark):
    df = spark.createDataFrame([("a", 1), ("a", None)], "x string, y int")
    assert values(df.select(text.joined_key(F.col("x"), F.col("y")))) == ["a|1", None]


def test_rounding_rules(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "v double")
    assert values(df.select(numbers.round_half_even(F.col("v")))) == [0.0, 2.0, 2.0]
    assert values(df.select(F.round("v"))) == [1.0, 2.0, 3.0]


def test_window_ends_at_midnight_unless_repaired(spark):
    df = spark.createDataFrame(
        [(datetime(2022, 12, 31, 8),), (datetime(2022, 12, 31),), (datetime(2023, 1, 1),)],
        "c timestamp")
    window = ("2022-01-01", "2022-12-31")
    assert df.where(extract.in_window(F.col("c"), window)).count() == 1
    assert df.where(extract.in_window(F.col("c"), window, "repaired")).count() == 2


def test_interval_across_the_year_end(spark, calendar):
    df = spark.createDataFrame(
        [(date(2000, 1, 1), date(1999, 12, 30)), (date(1999, 12, 30), date(2000, 1, 2)),
         (date(2000, 3, 1), date(2000, 3, 4)), (date(1900, 1, 1), date(2000, 1, 1))],
        "s date, e date")
    faithful = extract.with_interval(df, calendar, "s", "e")
    assert sorted(r[DAYS] for r in faithful.collect()) == [-362, 3, 363]
    repaired = extract.with_interval(df, calendar, "s", "e", mode="repaired")
    assert sorted(r[DAYS] for r in repaired.collect()) == [-2, 3, 3]


def test_clean_drops_negative_and_missing_and_lifts_zero(spark):
    df = spark.createDataFrame(
        [(-1, "INS", "False", "False", "No"), (None, "INS", "x", "x", "x"),
         (0, "DIS", "False", "false", "Yes"), (5, "Grooms", "false", "true", "Y")],
        f"{DAYS} int, orderAction string, isBuildingAdd string, is3rdpartycoloneeded string, "
        "Expedite string")
    got = [tuple(r) for r in clean.clean(df).orderBy(DAYS).collect()]
    assert got == [(1, "Disconnect", "false", "false", "Y"), (5, "Grooms", "false", "true", "Y")]


def test_append_fills_missing_columns(spark):
    left = spark.createDataFrame([(1, "a")], "x int, y string")
    right = spark.createDataFrame([(2,)], "x int")
    assert sorted(map(tuple, clean.append_rows(left, right).collect())) == [(1, "a"), (2, None)]


def test_split_by_jeop_covers_all_rows(spark):
    df = spark.createDataFrame([("None",), ("AMO",)], "taskJeop string")
    plain, jeop = clean.split_by_jeop(df)
    assert (values(plain), values(jeop)) == (["None"], ["AMO"])


def test_extract_modes_and_shapes(source):
    window = ("1995-01-01", "2000-12-31")
    tasks = extract.extract_tasks(source, window=window)
    assert tasks.columns[2:4] == ["_id", "taskid"] and len(tasks.columns) == 27
    plain = extract.extract_tasks(source, window=window, keep_ids=False)
    assert [c.lower() for c in plain.columns] == [c.lower() for c in TASK_COLUMNS]
    repaired = extract.extract_tasks(source, window=window, mode="repaired")
    assert repaired.count() == tasks.count()
    assert repaired.agg(F.max(DAYS)).first()[0] >= tasks.agg(F.max(DAYS)).first()[0]


def test_schema_check_names_the_column(spark):
    df = spark.createDataFrame([("a",)], "PID string")
    with pytest.raises(ValueError, match="PID: expected whole.*phaseName"):
        check_schema(df, SOURCE_SCHEMAS["phases"], "phases")


def test_warehouse_check_accepts_timestamps_and_text_keys(source):
    calendar = source.calendar.withColumn("date", F.col("date").cast("timestamp"))
    orders = source.orders.withColumn("sourcekey", F.col("sourcekey").cast("string"))
    changed = source._replace(calendar=calendar, orders=orders)
    assert isinstance(changed.checked(), Warehouse)


def test_extract_takes_timestamps(source):
    """Times of day change neither the intervals nor the rows of a date-only window."""
    def later(df, *columns):
        return df.withColumns({c: F.col(c).cast("timestamp") + F.expr("interval 9 hours")
                               for c in columns})

    timed = source._replace(tasks=later(source.tasks, "startDate", "completeDate"))
    window = ("1995-01-01", "2000-12-31")
    want = extract.extract_tasks(source, window=window).drop("startdate", "completedate")
    got = extract.extract_tasks(timed, window=window).drop("startdate", "completedate")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
