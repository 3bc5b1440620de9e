import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from taskspan.operators import daybits, rework
from taskspan.sources import mapping

EPOCH = date(1970, 1, 1)
SPANS = "orderID string, subIntID int, subIntervalName string, startDate date, completeDate date"


def random_spans(seed, rows=400, groups=25):
    """Rows about 1970, some the wrong way round, without a date or without a name."""
    rng = random.Random(seed)
    for _ in range(rows):
        start = EPOCH + timedelta(rng.randint(-900, 900))
        end = start + timedelta(rng.choice([0, 1, 3, 63, 64, 65, 200, -1, -70]))
        yield (f"o{rng.randrange(groups)}", rng.randrange(3), rng.choice(["t", "t", "t", None]),
               rng.choice([start] * 9 + [None]), rng.choice([end] * 9 + [None]))


def brute_force(rows, off):
    """Business dates and named rows by group, for groups that have a valid span."""
    dates, named = {}, {}
    for order, task, name, start, end in rows:
        key = (order, task)
        named[key] = named.get(key, 0) + (name is not None)
        if start and end and start <= end:
            dates.setdefault(key, set()).update(
                start + timedelta(d) for d in range((end - start).days + 1))
    return {key: sorted(days - off) for key, days in dates.items()}, named


@pytest.mark.parametrize("seed", [1, 2])
def test_bitmaps_against_sets_of_dates(spark, seed):
    rows = list(random_spans(seed))
    df = spark.createDataFrame(rows, SPANS).repartition(5)
    calendar = mapping.calendar_between(spark, 1969, 1971).cache()
    off = {r["date"] for r in calendar.where("isworkday = 0").collect()}
    want, named = brute_force(rows, off)
    listed = rework.group_dates(df, calendar, from_year=1969).collect()
    assert {(r["orderID"], r["subIntID"]): r["B_dates"] for r in listed} == want
    counted = {(r["orderID"], r["subIntID"]): r["days"]
               for r in rework.rework_days(df, calendar, from_year=1969).collect()}
    assert counted == {key: len(days) for key, days in want.items()}
    again = rework.rework_days(df, calendar, from_year=1969, repeated=True).collect()
    assert {(r["orderID"], r["subIntID"]): r["days"] for r in again} == {
        key: days for key, days in counted.items() if named[key] > 1}


def test_spans_within_words(spark):
    rows = [(a, b, w) for w in (-1, 0, 1) for a, b in [
        (0, 63), (-64, 127), (5, 5), (63, 64), (64, 63), (70, 80), (-1, -1), (-10, 130)]]
    df = spark.createDataFrame(rows, "a int, b int, w int")
    bits = daybits.span_bits(F.col("a"), F.col("b"), F.col("w"))
    for r in df.select("*", bits.alias("bits")).collect():
        want = sum(1 << (d & 63) for d in range(r["a"], r["b"] + 1) if d >> 6 == r["w"])
        assert r["bits"] & (1 << 64) - 1 == want


def test_lowest_day_of_a_word(spark):
    df = spark.createDataFrame([(d,) for d in (-65, -64, -1, 0, 62, 63, 64, 20_000)], "day int")
    day = F.col("day")
    both = daybits.bit_of(day).bitwiseOR(daybits.bit_of(F.lit(63)))
    for r in df.select("day", daybits.lowest_day(both, daybits.word_of(day)).alias("low")).collect():
        assert r["low"] == r["day"]


def test_empty_tables(spark, calendar):
    none = spark.createDataFrame([], SPANS)
    assert rework.rework_days(none, calendar, from_year=1995).isEmpty()
    assert rework.group_dates(none, calendar, from_year=1995).isEmpty()
    rows = spark.createDataFrame([("o", 1, "t", date(1999, 3, 5), date(1999, 3, 8))], SPANS)
    assert rework.rework_days(rows, calendar.limit(0), from_year=1995).first()["days"] == 4
    assert len(rework.group_dates(rows, calendar.limit(0), from_year=1995).first()["B_dates"]) == 4


def test_days_of_a_group_need_no_window_and_no_order(spark, calendar):
    df = spark.createDataFrame(list(random_spans(3)), SPANS)
    plan = rework.rework_days(df, calendar, from_year=1995)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort " not in plan and "Join" not in plan
    assert "partial_bit_or" in plan
