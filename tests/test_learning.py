import random
from dataclasses import replace
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from taskspan.operators import boost, configs, dictionary, metrics, trees
from taskspan.plans import queries
from taskspan.schema import CONFIG_KEYS, DAYS, FEATURES
from taskspan.sources.stage import stage, stage_path

SYSTEMS = ("CORE", "Netbuild", "BPM-QS")


def rows(spark, n, seed, systems=SYSTEMS):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        task, system = rng.randint(0, 9), rng.choice(systems)
        days = 1 + task * 3 + 5 * systems.index(system) + rng.randint(0, 6)
        data.append((f"o{i}", task, system, task % 3, "A", "Standard", "N", "Install", "None",
                     rng.choice(["C0", "C1"]), days))
    return spark.createDataFrame(
        data, "orderID string, subIntID int, sourceSystem string, PID int, orderClassType string, "
              "T_projecttype string, Expedite string, orderAction string, "
              f"orderDescription string, categoryCD string, {DAYS} int")


@pytest.fixture(scope="module")
def train(spark):
    return stage(rows(spark, 1500, 1), "train")


@pytest.fixture(scope="module")
def test_rows(spark):
    return stage(rows(spark, 400, 2), "test")


@pytest.fixture(scope="module")
def model(train):
    return boost.fit_quantile_boost(train, rounds=8, rate=0.3, max_depth=4)


def loss(df):
    return metrics.pinball_loss(df, 0.75).first()["pinball_loss"]


def test_boosting_beats_the_constant_and_improves(model, train):
    actual = train.withColumnRenamed(DAYS, "Actual")
    losses = []
    for rounds in (0, 2, 8):
        part = replace(model, rounds=model.rounds[:rounds])
        losses.append(loss(part.predict(actual)))
    assert losses[0] > losses[1] > losses[2] and losses[2] < 0.6 * losses[0]


def test_model_survives_saving(spark, model, test_rows):
    path = model.save(spark, stage_path(spark, "model"))
    again = boost.QuantileBoost.load(spark, path)
    want = model.predict(test_rows).select("orderID", "Prediction")
    got = again.predict(test_rows).select("orderID", "Prediction")
    assert want.exceptAll(got).isEmpty() and got.count() == test_rows.count()


@pytest.mark.parametrize("name", ["quantile_boost_predict", "scored_table", "scored_columns"])
def test_model_queries_score_stored_rows(spark, monkeypatch, name):
    """The plan of the test rows, many times over in one plan, filled the driver's heap."""
    fit = boost.fit_quantile_boost
    monkeypatch.setattr(boost, "fit_quantile_boost", lambda train, **_: fit(train, rounds=1))
    monkeypatch.setattr(queries, "_models", {})
    scored = queries.QUERIES[name](spark, SF)
    assert not [f for f in scored.inputFiles() if f.endswith(("lineitem.parquet", "orders.parquet"))]
    assert not [f for f in scored.inputFiles() if "test-tasks" in f]


def test_unseen_categories_are_scored(spark, model, train):
    strange = rows(spark, 20, 5, ("Elsewhere",))
    assert model.predict(strange).where(F.col("Prediction").isNull()).isEmpty()
    found = boost.unseen_categories(train, strange)
    assert [tuple(r) for r in found.collect()] == [("sourceSystem", "Elsewhere", 20)]


def test_scored_table_rounds_half_even(model, test_rows):
    scored = boost.scored_table(model, test_rows)
    assert scored.columns == ["orderID", *FEATURES, "Actual", "Prediction"]
    assert scored.where(F.col("Prediction") != F.floor("Prediction")).isEmpty()


def test_runs_with_different_settings_share_a_table(spark, model, test_rows):
    scored = stage(boost.scored_table(model, test_rows, rounded=False), "scored")
    path = stage_path(spark, "runs")
    for settings in (model.settings, {"alpha": 0.5, "other": 1.0}):
        runs = boost.log_run(
            boost.run_record(settings, metrics.eval_metrics(scored), "somewhere"), path)
    found = [r["settings"] for r in runs.orderBy("logged_at").collect()]
    assert found == [model.settings, {"alpha": 0.5, "other": 1.0}]
    assert {"rounds", "rate", "max_depth", "min_leaf", "leaves"} <= set(model.settings)
    assert {"rmse", "mae", "r2", "median_ae", "model_path"} <= set(runs.columns)


def test_scoring_reads_the_rows_once_and_stores_none(spark, model, test_rows, monkeypatch):
    monkeypatch.setattr(boost, "stage", lambda df, name: pytest.fail("a stage was written"))
    many = replace(model, rounds=model.rounds * 40)
    scored = many.predict(test_rows)
    assert scored.count() == test_rows.count() and scored.columns == [*test_rows.columns, "Prediction"]


def walked(model, row):
    """The prediction for one row by following every tree from its root."""
    codes = {(r["feature"], r["category"]): r["code"] for r in model.dictionary.collect()}
    score = model.base
    for tree in model.rounds:
        node = 0
        while node in tree.splits:
            split = tree.splits[node]
            name = model.features[split.feature]
            code = codes.get((name, str(row[name])), len(split.left) - 1)
            node = split.low if split.left[code] else split.high
        score += model.rate * tree.values[node]
    return score


def test_scores_are_those_of_the_trees_followed_row_by_row(model, test_rows):
    for row in model.predict(test_rows.limit(60)).collect():
        assert row["Prediction"] == walked(model, row)


def blocks_of(draw, rows, sizes, parts=1):
    out = []
    for _ in range(parts):
        codes = np.array([draw.integers(0, n + 1, rows) for n in sizes], np.int32)
        actual = (codes[0] * 3 + codes[1] % 2 * 5 + draw.integers(0, 9, rows)).astype(float)
        out.append(trees.Block(codes, actual, draw.integers(1, 5, rows), np.full(rows, 9.0)))
    return out


def test_the_first_cut_is_the_best_of_all_subsets():
    """Every feature, every set of its categories, by brute force."""
    sizes, draw = [4, 6, 3], np.random.default_rng(3)
    for _ in range(5):
        (block,) = blocks_of(draw, 120, sizes)
        gradient = np.where(block.actual > block.score, 0.75, -0.25) * block.weight

        def gain(inside):
            out = 0.0
            for some in (inside, ~inside):
                if block.weight[some].sum() < 10:
                    return -1.0
                out += gradient[some].sum() ** 2 / block.weight[some].sum()
            return out - gradient.sum() ** 2 / block.weight.sum()

        best = max(gain(np.isin(block.codes[f], left)) for f, n in enumerate(sizes)
                   for k in range(1, n + 1) for left in combinations(range(n + 1), k))
        tree = trees.grow(trees.Held([block]), sizes, alpha=0.75, leaves=2, max_depth=12, min_leaf=10)
        split = tree.splits[0]
        assert gain(split.left[block.codes[split.feature]]) == pytest.approx(best)


def test_leaves_depth_and_rows_of_a_leaf_are_bounded():
    sizes, draw = [9, 30, 7], np.random.default_rng(4)
    (block,) = blocks_of(draw, 4_000, sizes)
    for leaves, depth, least in ((128, 12, 5), (40, 3, 5), (128, 12, 900)):
        tree = trees.grow(trees.Held([block]), sizes, alpha=0.75, leaves=leaves, max_depth=depth, min_leaf=least)
        level = {0: 0}
        for node in sorted(tree.splits):
            level[tree.splits[node].low] = level[tree.splits[node].high] = level[node] + 1
        rows = np.bincount(tree.leaves(block.codes), block.weight)
        assert len(tree.splits) + 1 <= leaves and max(level.values()) <= depth
        assert rows[rows > 0].min() >= least
    assert len(tree.splits) > 0


def test_any_number_of_tasks_gives_the_same_model(train):
    one = boost.fit_quantile_boost(train, rounds=3, leaves=12)
    many = boost.fit_quantile_boost(train, rounds=3, leaves=12, task_rows=200)
    assert [t.values for t in one.rounds] == [t.values for t in many.rounds]
    assert [[(n, s.feature, s.left.tolist()) for n, s in sorted(t.splits.items())] for t in one.rounds] == [
        [(n, s.feature, s.left.tolist()) for n, s in sorted(t.splits.items())] for t in many.rounds]


def test_a_quarter_of_a_million_cells_need_no_job_per_sum(spark, monkeypatch):
    """Twelve jobs a round over all cells took most of the time of a fit."""
    many = rows(spark, 1, 1).drop("orderID", "subIntID", DAYS).crossJoin(spark.range(250_000)).select(
        "*", (F.col("id") % 40).cast("int").alias("subIntID"),
        (F.col("id") / 40 + F.col("id") % 40 * 100).cast("int").alias(DAYS))
    monkeypatch.setattr(boost, "_spread_rounds", lambda *_: pytest.fail("a job per sum"))
    model = boost.fit_quantile_boost(many, rounds=2, leaves=4)
    assert [len(tree.values) for tree in model.rounds] == [4, 4]


@pytest.mark.parametrize("most", [trees.PACKED_ROWS, 1])
def test_a_task_adds_up_combinations_as_others_add_up_cells(most, monkeypatch):
    """Repeated cells, scores that differ within a combination, both ways to count."""
    monkeypatch.setattr(trees, "PACKED_ROWS", most)
    monkeypatch.setattr(trees, "TOGETHER", 60)
    sizes, draw = [9, 300, 7, 2], np.random.default_rng(8)
    blocks = blocks_of(draw, 900, sizes, parts=3)
    blocks[1].score[:] = draw.choice([9.0, 11.5], 900)
    blocks[2].actual[:] += draw.choice([0.0, 0.25], 900)
    blocks.append(blocks[0])
    held, first = trees.Held(list(blocks)), np.append(0, np.cumsum(np.array(sizes) + 1))
    for _ in range(3):
        tree = trees.grow(held, sizes, alpha=0.75, leaves=20, max_depth=12, min_leaf=5)
        leaves = [leaf for leaf in range(2 * len(tree.splits) + 1) if leaf not in tree.splits]
        asked = tree, leaves, int(first[-1]), first[:-1]
        assert len(leaves) == 20 and (held.sums(*asked) == trees._sums(blocks, *asked)).all()
        tree.values = held.quantiles(tree, 0.75)
        assert set(tree.values) == set(leaves)
        for leaf, value in tree.values.items():
            found = np.concatenate([np.repeat((b.actual - b.score)[at], b.weight[at]) for b in blocks
                                    for at in [tree.leaves(b.codes) == leaf]])
            assert value == pytest.approx(np.quantile(found, 0.75), abs=1e-12)
        held.add(tree, 0.3)
        blocks = [trees.with_scores(b, tree, 0.3) for b in blocks]


@pytest.mark.parametrize("alpha", [0.0, 0.5, 0.75, 1.0])
def test_quantile_of_a_leaf_is_found_by_cells(alpha):
    """Ties, one far value, neighbouring numbers and a step at the rank; far more than are put in order."""
    draw = np.random.default_rng(6)
    close = 1.0 + np.arange(5_000) % 3 * np.finfo(float).eps
    for value in (draw.normal(size=20_000), np.append(draw.random(20_000), 1e300), close,
                  np.repeat([1.0, 2.0, 3.0, 4.0], 2_500), np.full(5_000, 3.5),
                  np.append(np.full(4_000, -1e308), np.full(4_000, 1e308))):
        weight = draw.integers(1, 5, len(value)).astype(np.int16)
        got = trees._quantile(value, weight, alpha)
        place = (int(weight.sum()) - 1) * alpha
        rows = np.sort(np.repeat(value, weight))
        low, high, share = rows[int(place)], rows[-int(-place // 1)], place % 1
        assert got == (low if low == high else (1 - share) * low + share * high)


def test_a_task_without_cells_has_no_sums():
    tree = trees.fitted(trees.Held([]), [3, 2], alpha=0.75, leaves=8, max_depth=3, min_leaf=1)
    assert not tree.splits and tree.values == {0: 0.0}


@pytest.mark.parametrize("kept", [8, 512])
@pytest.mark.parametrize("alpha", [0.5, 0.75, 0.99])
def test_quantiles_of_all_leaves_at_once(kept, alpha):
    """One leaf has nine of ten rows, all of distinct residuals; tasks report few of them."""
    draw = np.random.default_rng(5)
    tree = trees.Tree({0: trees.Split(0, np.array([True, False, False]), 1, 2),
                       2: trees.Split(0, np.array([False, True, False]), 3, 4)})
    parts = []
    for _ in range(3):
        code = np.where(draw.random(2_000) < 0.9, 0, 1).astype(np.int32)
        parts.append(trees.Block(code[None, :], draw.normal(size=2_000), draw.integers(1, 4, 2_000),
                                 np.zeros(2_000)))

    class Tasks(trees.Held):
        def residuals(self, *asked):
            return [r for b in self.blocks for r in trees._residuals([b], *asked)]

    got = trees.leaf_values(Tasks(parts), tree, alpha, kept)
    code, value, weight = (np.concatenate(x) for x in zip(*((b.codes[0], b.actual, b.weight) for b in parts)))
    for leaf, which in ((1, 0), (3, 1)):
        rows = np.repeat(value[code == which], weight[code == which])
        assert got[leaf] == pytest.approx(np.quantile(rows, alpha), abs=1e-12)
    assert got[4] == 0.0 and set(got) == {1, 3, 4}


def test_a_feature_of_many_categories(spark, monkeypatch):
    """Codes are ranks by rows, then text; no label passes through the driver."""
    many = spark.range(200_000).select(
        F.lit("x").alias("a"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("b")).unionByName(
        spark.createDataFrame([("y", "c7"), ("y", "c7"), ("y", "c3"), (None, None)], "a string, b string"))
    monkeypatch.setattr(type(many), "collect", lambda self: pytest.fail("rows came to the driver"))
    found = dictionary.category_dictionary(many, ["a", "b"])
    monkeypatch.undo()
    assert found.where("feature = 'b'").agg(F.count("*"), F.count_distinct("code"), F.max("code")).first()[:] == (
        200_000, 200_000, 199_999)
    order = [r["category"] for r in found.where("feature = 'b' and code < 6").orderBy("code").collect()]
    assert order == ["c7", "c3", "c0", "c1", "c10", "c100"]
    assert dictionary.dictionary_sizes(found, ["b", "a", "none"]) == [200_000, 2, 0]
    coded = dictionary.encode(spark.createDataFrame(
        [("x", "c7"), ("z", None), (None, "c3")], "a string, b string"), found, ["a", "b"])
    assert sorted(tuple(r)[2:] for r in coded.collect()) == [(-1, -1), (-1, 1), (0, 0)]


def test_missing_categories_are_scored(spark, model, test_rows):
    holes = test_rows.limit(30).withColumn("categoryCD", F.lit(None).cast("string"))
    assert model.predict(holes).where(F.col("Prediction").isNotNull()).count() == 30


def test_leaf_quantiles_are_exact_unless_a_grid_is_given(spark):
    rows = spark.createDataFrame([(1, 0.1234, 3), (1, 0.5678, 1), (2, 9.0, 1)],
                                 "leaf int, e double, w long")
    def found(**options):
        return {r["leaf"]: r["value"] for r in boost.leaf_quantiles(
            rows, leaf="leaf", residual=F.col("e"), weight=F.col("w"), alpha=0.5, **options).collect()}
    assert found() == {1: 0.1234, 2: 9.0} and found(decimals=2) == {1: 0.12, 2: 9.0}


@pytest.mark.parametrize("errors", [[1.0], [1.0, 2.0], [0.5, 0.50001, 7.25, 300.0],
                                    [2.0] * 50 + [3.0] * 50, [i * 0.137 for i in range(1001)]])
@pytest.mark.parametrize("p", [0.5, 0.9])
@pytest.mark.parametrize("few", [50_000, 5])
def test_exact_quantile(spark, errors, p, few, monkeypatch):
    """With few rows left to order, the range is cut again and again."""
    monkeypatch.setattr(metrics, "_FEW", few)
    monkeypatch.setattr(metrics, "_CELLS", 7)
    df = spark.createDataFrame([(e,) for e in errors], "e double")
    want = df.agg(F.percentile("e", p)).first()[0]
    assert metrics.exact_quantile(df, "e", p, "q").first()["q"] == pytest.approx(want, abs=1e-12)


def test_eval_metrics(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0), (6, 3.0)], "Actual int, Prediction double")
    row = metrics.eval_metrics(df).first()
    assert row["rmse"] == pytest.approx((10 / 3) ** 0.5) and row["mae"] == pytest.approx(4 / 3)
    assert row["r2"] == pytest.approx(1 - 10 / 14) and row["median_ae"] == 1.0


def test_quantile_lookup_backs_off(spark):
    train = rows(spark, 200, 9)
    known = train.limit(1)
    new_config = known.withColumn("categoryCD", F.lit("Z"))
    new_task = known.withColumn("subIntID", F.lit(99))
    test = known.unionByName(new_config).unionByName(new_task)
    got = {(r["subIntID"], r["categoryCD"]): r["Prediction"]
           for r in configs.quantile_lookup(train, test).collect()}
    row = known.first()
    same_task = train.where(F.col("subIntID") == row["subIntID"])
    same = same_task
    for key in CONFIG_KEYS:
        same = same.where(F.col(key) == row[key])

    def p75(df):
        return df.agg(F.percentile(DAYS, 0.75)).first()[0]

    assert got[(row["subIntID"], row["categoryCD"])] == p75(same)
    assert got[(row["subIntID"], "Z")] == p75(same_task)
    assert got[(99, row["categoryCD"])] == p75(train)


def test_config_stats_key_and_rounding(spark):
    df = rows(spark, 300, 4)
    stats = configs.config_stats(df).cache()
    assert stats.agg(F.sum("count")).first()[0] == 300
    row = stats.first()
    assert row["config"] == "|".join(row[k] for k in CONFIG_KEYS)
    assert row["mean"] == round(row["mean"])
