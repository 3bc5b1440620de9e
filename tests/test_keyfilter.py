"""The bitmap of keys keeps every row that a join would, and few others."""

import pytest
from pyspark.sql import functions as F

from taskspan.operators import extract, keyfilter
from taskspan.operators.keyfilter import KeyFilter
from taskspan.plans.queries import TEST, TRAIN
from taskspan.sources.stage import stage


@pytest.fixture(autouse=True)
def few_keys_too(monkeypatch):
    monkeypatch.setattr(keyfilter, "LEAST_KEYS", 0)


@pytest.fixture(scope="module")
def keys(spark):
    return stage(spark.range(0, 40_000, 8).withColumnRenamed("id", "k"), "keys")


@pytest.mark.parametrize("kind", ["long", "int", "short"])
def test_no_key_is_lost_and_few_others_stay(spark, keys, kind):
    rows = spark.range(0, 32_000).select(F.col("id").cast(kind).alias("k"))
    kept = KeyFilter(keys, "k").may_hold(rows)
    assert rows.join(keys.withColumnRenamed("k", "_k"), F.col("k") == F.col("_k"), "left_semi").exceptAll(kept).isEmpty()
    assert kept.count() < 4_000 + 0.2 * 28_000


def test_bounded_bitmap_only_keeps_more(spark, keys, monkeypatch):
    monkeypatch.setattr(keyfilter, "MOST_WORDS", 1 << 6)
    known = KeyFilter(keys, "k")
    assert known.words == 64 and len(known.bits.first()["bits"]) == 64
    assert keys.exceptAll(known.may_hold(keys)).isEmpty()


def test_few_keys_make_no_bitmap(keys, monkeypatch):
    monkeypatch.setattr(keyfilter, "LEAST_KEYS", 5_001)
    known = KeyFilter(keys, "k")
    assert known.bits is None and known.may_hold(keys) is keys
    monkeypatch.setattr(keyfilter, "LEAST_KEYS", 5_000)
    assert KeyFilter(keys, "k").bits is not None


def test_odd_keys(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("",), (None,), ("a",)], "k string")
    known = KeyFilter(stage(rows.where("k in ('a', '')"), "keys"), "k")
    kept = [r["k"] for r in known.may_hold(rows).collect()]
    assert kept.count("a") == 2 and kept.count("") == 1
    assert KeyFilter(stage(rows.where("false"), "keys"), "k").may_hold(rows).isEmpty()
    numbers = spark.createDataFrame([(1,), (None,)], "k long")  # text meets numbers in the join alone
    assert known.may_hold(numbers).count() == 2
    assert KeyFilter(stage(numbers, "keys"), "k").may_hold(numbers.where("k = 1")).count() == 1


def test_tasks_of_other_orders_are_not_shuffled(source):
    orders = stage(extract.eligible_orders(source.orders, status="Completed", window=TRAIN), "orders")
    mine = source.tasks.join(orders.select("sourcekey"), "sourcekey", "left_semi").count()
    rows = extract.extract_tasks(source, window=TRAIN)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "getbit" in plan and "getbit" in extract.extract_cancelled_dependency(
        source, window=TRAIN)._jdf.queryExecution().optimizedPlan().toString()
    some = KeyFilter(orders, "sourcekey").may_hold(source.tasks).count()
    assert mine <= some < mine + 0.2 * (source.tasks.count() - mine)


def test_test_rows_are_filtered_too(source):
    """The lookup of predictions extracts both windows, by the same step."""
    rows = extract.extract_tasks(source, window=TEST, start_col="originalstartDate",
                                 complete_col="originalcompleteDate", keep_ids=False)
    assert "getbit" in rows._jdf.queryExecution().optimizedPlan().toString()
