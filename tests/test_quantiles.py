"""Quantiles of many groups against `percentile`."""

import pytest
from pyspark.sql import functions as F

from taskspan.operators import quantiles


def expected(df, keys, alpha, weight):
    found = df.where("v is not null and not isnan(v) and abs(v) < double('inf') and w > 0").groupBy(*keys).agg(
        F.percentile("v", alpha, F.col("w") if weight else F.lit(1)).alias("quantile"))
    return {tuple(r)[:-1]: r["quantile"] for r in found.collect()}


def found(df, keys, alpha, weight):
    rows = quantiles.group_quantiles(df, keys, "v", alpha, weight="w" if weight else None).collect()
    assert len({tuple(r)[:-1] for r in rows}) == len(rows)
    return {tuple(r)[:-1]: r["quantile"] for r in rows}


@pytest.mark.parametrize("alpha, cells", [(0.75, 1_024), (0.5, 2), (1.0, 16)])
def test_a_group_with_most_rows_and_only_distinct_values(spark, monkeypatch, alpha, cells):
    monkeypatch.setattr(quantiles, "CELLS", cells)
    rows = 20_000 if cells > 2 else 300
    df = spark.range(rows).select(
        F.when(F.col("id") % 10 > 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 70)).alias("k"),
        ((F.xxhash64("id") % 1_000_003) / 7.0).alias("v"), (F.col("id") % 3 + 1).alias("w")).cache()
    assert found(df, ["k"], alpha, True) == pytest.approx(expected(df, ["k"], alpha, True), rel=1e-15)


def test_missing_keys_ties_outliers_and_values_that_are_left_out(spark):
    nan, inf = float("nan"), float("inf")
    data = [("a", 1, float(x), 1) for x in (1, 1, 1, 2, 5)] + [("a", None, x, 1) for x in (1e300, -1e300, 0.5, 3e-320)]
    data += [(None, 1, x, 2) for x in (4.0, 4.0, nan, inf, -inf, None, 9.0)] + [("b", 2, None, 1), ("c", 2, 7.0, 0)]
    data += [("d", 1, 1.0, 1), ("d", 1, 1.0 + 2 ** -52, 1), ("e", 1, -1.5e308, 1), ("e", 1, 1.5e308, 3)]
    df = spark.createDataFrame(data, "k string, t int, v double, w long").cache()
    for alpha in (0.0, 0.3, 0.75):
        for weight in (True, False):
            rows = df if weight else df.where("w > 0")
            have, want = found(rows, ["k", "t"], alpha, weight), expected(rows, ["k", "t"], alpha, weight)
            assert have.pop(("b", 2)) is None and have.pop(("c", 2), None) is None
            assert have == pytest.approx(want, rel=1e-15)


def test_no_keys_and_no_rows(spark):
    df = spark.range(1_000).select((F.col("id") / 3).alias("v"), F.lit(1).alias("w"))
    assert found(df, [], 0.75, False) == pytest.approx(expected(df, [], 0.75, False))
    empty = df.withColumn("k", F.lit("x")).limit(0)
    assert found(empty, ["k"], 0.75, False) == {}
    assert set(found(empty, [], 0.75, False).values()) <= {None}
