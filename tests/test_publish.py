"""The whole batch on the smallest tables."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from taskspan.operators.boost import QuantileBoost
from taskspan.plans import prepare
from taskspan.plans.publish import Publisher, publish_model, publish_tables, published_counts
from taskspan.schema import CONFIG_STATS_COLUMNS, FEATURES, TASK_COLUMNS, TRAIN_COLUMNS
from taskspan.sources import mapping
from taskspan.sources import stage as stages
from taskspan.sources.stage import stage_path
from taskspan.sources.tables import FailedCheck


@pytest.fixture(scope="module")
def publisher(spark):
    return Publisher(stage_path(spark, "published"))


@pytest.fixture(scope="module")
def tables(source, publisher):
    return publish_tables(
        source, publisher, train_window=mapping.TRAIN_WINDOW, test_window=mapping.TEST_WINDOW,
        from_year=mapping.NONWORK_FROM_YEAR)


def test_columns_of_the_tables(tables):
    assert tuple(tables["binned_tasks"].columns) == TASK_COLUMNS
    assert set(tables["merged_tasks"].columns) == {*TASK_COLUMNS, "count", "B_dates"}
    assert tuple(tables["train_data"].columns) == TRAIN_COLUMNS
    assert tuple(tables["train_stats"].columns) == CONFIG_STATS_COLUMNS
    assert tuple(tables["test_data"].columns) == TASK_COLUMNS
    assert {"Category", "Outlier_threshold"} <= set(tables["preprocessed_tasks"].columns)


def test_rows_of_the_tables(spark, source, publisher, tables):
    counts = {r["stage"]: r["rows"] for r in published_counts(spark, publisher).collect()}
    assert counts["train_data"] == counts["merged_tasks"]
    assert tables["train_stats"].agg(F.sum("count")).first()[0] == counts["train_data"]
    direct = prepare.prepare_train(
        source, window=mapping.TRAIN_WINDOW, from_year=mapping.NONWORK_FROM_YEAR)
    merged = tables["merged_tasks"].select(*direct.columns)
    assert direct.exceptAll(merged).isEmpty() and counts["merged_tasks"] == direct.count()


def test_publishing_again_replaces(source, publisher, tables):
    rows = tables["train_data"].count()
    for _ in range(2):
        assert publisher.write("copy", tables["train_data"]).count() == rows


def test_model_run(spark, publisher, tables):
    model, runs = publish_model(tables, publisher, rounds=3, rate=0.3)
    assert runs.count() == 1 and runs.first()["settings"]["rounds"] == 3
    scored = publisher.read(spark, "scored_data")
    assert scored.columns == ["orderID", *FEATURES, "Actual", "Prediction"]
    assert scored.count() == tables["test_data"].count()
    assert scored.where(F.col("Prediction") != F.floor("Prediction")).isEmpty()
    again, runs = publish_model(tables, publisher, rounds=2, rate=0.2, max_depth=3)
    found = {r["settings"]["rounds"]: r["model_path"] for r in runs.collect()}
    for fitted, rounds in ((model, 3), (again, 2)):
        loaded = QuantileBoost.load(spark, found[rounds])
        assert len(loaded.rounds) == rounds and loaded.base == fitted.base
        assert loaded.settings == fitted.settings


def test_repaired_test_rows_are_binned_like_the_training_rows(spark, source):
    publisher = Publisher(stage_path(spark, "repaired"))
    options = {"train_window": mapping.TRAIN_WINDOW, "test_window": mapping.TEST_WINDOW,
               "from_year": mapping.NONWORK_FROM_YEAR}
    tables = publish_tables(source, publisher, mode="repaired", **options)
    assert tables["test_data"].where("categoryCD = 'Others'").count() > 0


def test_publishing_again_with_a_database_and_another_schema(spark, tables):
    spark.sql("create database if not exists published_twice")
    try:
        named = Publisher(stage_path(spark, "named"), database="published_twice")
        first = named.write("rows", tables["train_data"])
        assert first.count() == tables["train_data"].count()
        other = spark.range(7).withColumn("more", F.lit("x"))
        again = named.write("rows", other)
        assert again.count() == 7 and again.columns == ["id", "more"]
        assert spark.table("published_twice.rows").count() == 7
        moved = Publisher(stage_path(spark, "moved"), database="published_twice")
        assert moved.write("rows", other.limit(2)).count() == 2
    finally:
        spark.sql("drop database published_twice cascade")


@pytest.mark.parametrize("database", [None, "checked_tables"])
def test_a_failed_check_leaves_the_table_before(spark, database):
    if database:
        spark.sql(f"create database if not exists {database}")
    try:
        some = Publisher(stage_path(spark, "checked"), database=database)
        rows = spark.range(10)
        some.publish("rows", rows, {"small": F.col("id") < 10})
        with pytest.raises(FailedCheck, match="2 rows not small"):
            some.publish("rows", spark.range(12), {"small": F.col("id") < 10})
        with pytest.raises(Exception, match="half-way"):  # the write itself breaks off
            some.publish("rows", rows.repartition(4).select(
                F.when(F.col("id") == 7, F.raise_error(F.lit("half-way"))).otherwise(F.col("id"))
                .cast("long").alias("id")))
        assert some.read(spark, "rows").count() == 10
        assert [r["rows"] for r in some.present(spark).collect()] == [10]
        if database:
            assert spark.table(f"{database}.rows").count() == 10
    finally:
        if database:
            spark.sql(f"drop database {database} cascade")


def test_a_reader_under_way_keeps_its_rows(spark):
    spark.sql("create database if not exists read_meanwhile")
    try:
        some = Publisher(stage_path(spark, "meanwhile"), database="read_meanwhile")
        some.publish("rows", spark.range(5))
        by_path, by_name = some.read(spark, "rows"), spark.table("read_meanwhile.rows").where("id >= 0")
        by_path.schema, by_name.schema
        began = by_path.toLocalIterator()
        first = next(began)
        some.publish("rows", spark.range(9))
        assert 1 + sum(1 for _ in began) == 5 and first["id"] in range(5)
        assert by_path.count() == 5
        assert spark.table("read_meanwhile.rows").count() == 9 == some.read(spark, "rows").count()
        assert by_name.count() in (5, 9)  # never a mixture, never an error
        some.publish("rows", spark.range(3))
        assert some.prune(spark, "rows", keep=2) == 1 and some.read(spark, "rows").count() == 3
        assert some.history(spark).count() == 3
    finally:
        spark.sql("drop database read_meanwhile cascade")


def test_the_name_is_never_missing_when_only_the_place_changes(spark, monkeypatch):
    spark.sql("create database if not exists always_there")
    try:
        some = Publisher(stage_path(spark, "there"), database="always_there")
        some.publish("rows", spark.range(5))
        said, run = [], type(spark).sql
        monkeypatch.setattr(type(spark), "sql", lambda self, text, *a, **k: (
            said.append(text), run(self, text, *a, **k))[1])
        some.publish("rows", spark.range(6))
        assert any(text.startswith("ALTER TABLE") for text in said)
        assert not any(text.startswith("DROP") for text in said)
        assert run(spark, "select count(*) as n from always_there.rows").first()["n"] == 6
    finally:
        run(spark, "drop database always_there cascade")


def test_a_table_that_was_never_published(spark):
    some = Publisher(stage_path(spark, "few"))
    some.publish("rows", spark.range(1))
    with pytest.raises(LookupError):
        some.read(spark, "other")


def test_stages_of_a_run_are_removed(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(stages, "shared_folder", lambda spark: str(tmp_path))
    before = stages.stage(spark.range(2), "rows")
    with stages.run_stages(spark):
        with stages.run_stages(spark):
            assert stages.stage(spark.range(3), "rows").count() == 3
        assert stages.stage(spark.range(4), "rows").count() == 4
        assert len({p.parent for p in tmp_path.rglob("*.parquet")}) == 2
    assert len({p.parent for p in tmp_path.rglob("*.parquet")}) == 1 and before.count() == 2


def test_publishing_leaves_no_stages(spark, source, tables, publisher):
    folder = Path(stages.shared_folder(spark).removeprefix("file:"))
    assert not list(folder.glob("stages/*/run-*"))
    assert all(table.count() for table in tables.values())


def test_only_one_process_may_use_a_scratch_folder():
    class Session:
        class conf:
            get = staticmethod(lambda *names: None)

        class sparkContext:
            master = "local-cluster[2,1,1024]"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        stages.shared_folder(Session)


def test_registered_tables(spark, source, tables):
    spark.sql("create database if not exists published_test")
    try:
        named = Publisher(stage_path(spark, "named"), database="published_test")
        assert named.write("train_data", tables["train_data"]).count() == tables["train_data"].count()
        assert spark.table("published_test.train_data").columns == list(TRAIN_COLUMNS)
    finally:
        spark.sql("drop database published_test cascade")
