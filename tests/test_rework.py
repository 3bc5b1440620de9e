import random
from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from taskspan.operators import keyfilter, rework
from taskspan.operators.clean import clean, task_table
from taskspan.operators.extract import extract_tasks
from taskspan.schema import DAYS
from taskspan.sources import mapping
from taskspan.sources.stage import stage

SCHEMA = (f"orderID string, subIntID int, subIntervalName string, owner string, startDate date, "
          f"completeDate date, {DAYS} int")
# 1999-03-01 is a Monday.
MON, TUE, WED, FRI, SAT, SUN = (date(1999, 3, d) for d in (1, 2, 3, 5, 6, 7))
NEXT_MON = date(1999, 3, 8)


def merged(spark, calendar, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return rework.rework_merge(df, calendar, from_year=1995, **options)


def test_overlapping_repeats_count_distinct_days(spark, calendar):
    rows = [("o", 1, "t", "x", MON, WED, 2), ("o", 1, "t", "x", TUE, FRI, 3)]
    row = merged(spark, calendar, rows).collect()
    assert len(row) == 1 and row[0][DAYS] == 5 and row[0]["count"] == 2
    assert row[0]["B_dates"] == [date(1999, 3, d) for d in range(1, 6)]


def test_weekend_repeats_have_no_days(spark, calendar):
    rows = [("o", 1, "t", "x", SAT, SUN, 1)] * 2
    row = merged(spark, calendar, rows).first()
    assert row[DAYS] == 0 and row["B_dates"] == []


def test_single_task_keeps_its_interval(spark, calendar):
    rows = [("o", 1, "t", "x", FRI, NEXT_MON, 3)]
    row = merged(spark, calendar, rows).first()
    assert row[DAYS] == 3 and row["B_dates"] == [FRI, NEXT_MON]
    assert merged(spark, calendar, rows, recompute_singles=True).first()[DAYS] == 2


def old_calendar(spark):
    return mapping.calendar_between(spark, 1968, 1971).cache()


@pytest.mark.parametrize("start, complete", [
    (date(1969, 12, 1), date(1969, 12, 31)), (date(1969, 12, 20), date(1970, 1, 20)),
    (date(1967, 12, 20), date(1968, 1, 10)), (date(1971, 12, 1), date(1972, 2, 1)),
    (date(1966, 1, 1), date(1966, 1, 9)), (date(1960, 1, 1), date(1980, 1, 1)),
])
def test_forms_agree_before_1970_and_beside_the_calendar(spark, start, complete):
    off = {r["date"] for r in old_calendar(spark).where("isworkday = 0").collect()}
    days = [start + timedelta(d) for d in range((complete - start).days + 1)]
    want = sum(day not in off for day in days)
    rows = [("o", 1, "t", "x", start, complete, 1)] * 2 + [("o", 1, "t", "x", start, start, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for form in ("dates", "counts"):
        merged_rows = rework.rework_merge(df, old_calendar(spark), from_year=1968, form=form)
        assert [r[DAYS] for r in merged_rows.collect()] == [want]


def test_a_calendar_that_ends_before_1970(spark):
    calendar = mapping.calendar_between(spark, 1968, 1968)
    rows = [("o", 1, "t", "x", date(1968, 1, 1), date(1968, 1, 14), 1)] * 2
    for form in ("dates", "counts"):
        row = rework.rework_merge(
            spark.createDataFrame(rows, SCHEMA), calendar, from_year=1968, form=form).first()
        assert row[DAYS] == 9


def test_a_gap_in_the_calendar_is_an_error(spark):
    calendar = mapping.calendar_between(spark, 1968, 1968).where("date <> date'1968-01-03'")
    rows = [("o", 1, "t", "x", date(1968, 1, 1), date(1968, 1, 3), 1)] * 2
    with pytest.raises(Exception, match="the calendar lacks 1968-01-03"):
        rework.rework_merge(spark.createDataFrame(rows, SCHEMA), calendar, from_year=1968,
                            form="counts").collect()


def test_backward_span_has_no_dates(spark, calendar):
    rows = [("o", 1, "t", "x", date(2000, 1, 1), date(1999, 12, 30), 363)] * 2
    for form in ("dates", "counts"):
        assert merged(spark, calendar, rows, form=form).first()[DAYS] == 0


def test_first_value_that_is_there(spark, calendar):
    rows = [("o", 1, "t", None, MON, TUE, 1), ("o", 1, "t", "a", MON, WED, 2),
            ("o", 1, "t", "b", TUE, WED, 1)]
    for nullable in (None, ["owner"]):
        row = merged(spark, calendar, rows, nullable=nullable).first()
        assert row["owner"] == "a" and row["startDate"] == MON and row["completeDate"] == TUE


def test_missing_keys_and_names_drop(spark, calendar):
    rows = [(None, 1, "t", "x", MON, TUE, 1), ("o", None, "t", "x", MON, TUE, 1),
            ("p", 2, None, "x", MON, TUE, 1)]
    assert merged(spark, calendar, rows).isEmpty()


def test_rows_beside_one_named_row_stay(spark, calendar):
    rows = [("o", 1, "t", "x", MON, TUE, 1), ("o", 1, None, "y", MON, WED, 2),
            ("q", 1, "t", "x", MON, TUE, 1), ("q", 1, "t", "x", MON, TUE, 1),
            ("q", 1, None, "x", FRI, FRI, 1), ("r", 1, "t", "x", MON, TUE, 1)]
    got = sorted((r["orderID"], r["owner"], r[DAYS], r["count"])
                 for r in merged(spark, calendar, rows).collect())
    assert got == [("o", "x", 1, 1), ("o", "y", 2, 1), ("q", "x", 3, 2), ("r", "x", 1, 1)]
    assert merged(spark, calendar, rows, form="counts").count() == 4


def test_non_work_days_before_the_list_count(spark):
    calendar = mapping.calendar_between(spark, 1994, 1996)
    rows = [("o", 1, "t", "x", date(1994, 12, 31), date(1995, 1, 2), 1)] * 2  # Sat to Mon
    df = spark.createDataFrame(rows, SCHEMA)
    for from_year, days in ((1995, 2), (1994, 1)):
        for form in ("dates", "counts"):
            got = rework.rework_merge(df, calendar, from_year=from_year, form=form).first()
            assert got[DAYS] == days


@pytest.fixture(scope="module")
def stored_tasks(spark):
    source = mapping.warehouse(spark, "/root/testdata/sf0.01")
    rows = clean(extract_tasks(source, window=mapping.TRAIN_WINDOW))
    return source, stage(task_table(rows), "tasks")


def test_both_forms_agree(stored_tasks):
    source, tasks = stored_tasks
    forms = [
        rework.rework_merge(tasks, source.calendar, from_year=1995, form=form,
                            recompute_singles=True).select("orderID", "subIntID", "count", DAYS)
        for form in ("dates", "counts")
    ]
    assert forms[0].count() == forms[1].count() > 0
    assert forms[0].exceptAll(forms[1]).isEmpty()


def test_merge_invariants(stored_tasks):
    source, tasks = stored_tasks
    got = rework.rework_merge(tasks, source.calendar, from_year=1995).cache()
    assert got.agg(F.sum("count")).first()[0] == tasks.count()
    assert got.count() == tasks.select(*rework.REPEAT_KEYS).distinct().count()
    span = F.greatest(F.date_diff("completeDate", "startDate") + 1, F.lit(0))
    assert got.where((F.col("count") == 1) & (F.size("B_dates") > span)).isEmpty()


def test_repeat_count_per_row(stored_tasks):
    _, tasks = stored_tasks
    counted = rework.with_repeat_count(tasks)
    assert counted.count() == tasks.count()
    assert counted.where("count > 1").count() > 0


@pytest.mark.parametrize("repeats", [0, 0.1, 1])
def test_rows_alone_in_their_group_are_not_merged(spark, calendar, monkeypatch, repeats):
    draw = random.Random(7)
    rows = [(f"o{k}", k % 5, draw.choice(["t", "t", None]), draw.choice(["x", None]), MON, draw.choice([TUE, FRI, NEXT_MON]),
             draw.randint(0, 9)) for k in range(2_000)]
    rows += [row[:2] + draw.choice([("t", "y"), (None, "z")]) + (TUE, SUN, 3)
             for row in rows if draw.random() < repeats]
    rows += [(None, 1, "t", "x", MON, TUE, 1), ("o", None, "t", "x", MON, TUE, 1), ("o", 3, "t", "x", MON, None, None)]
    whole = merged(spark, calendar, rows, form="counts")
    want = Counter(whole.collect())
    monkeypatch.setattr(keyfilter, "LEAST_KEYS", 0)
    seen, first_rows = [], rework._first_rows
    monkeypatch.setattr(rework, "_first_rows", lambda df, *a: seen.append(df) or first_rows(df, *a))
    split = merged(spark, calendar, rows, form="counts")
    assert split.dtypes == whole.dtypes and Counter(split.collect()) == want
    several = [r for r, n in Counter(row[:2] for row in rows).items() if n > 1]
    assert seen[0].count() < 2 * len(several) + 0.2 * len(rows)
