"""The registered queries: every operator over the whole of the mapped test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskspan.functions import numbers, text
from taskspan.operators import boost, categories, clean, configs, dictionary, extract, metrics
from taskspan.operators import outliers, rework, stats
from taskspan.plans import prepare
from taskspan.schema import CONFIG_KEYS, DAYS, FEATURES, TASK_COLUMNS, TASK_IDS
from taskspan.sources import layout, mapping
from taskspan.sources.stage import stage, stage_path
from taskspan.sources.tables import Publications, Warehouse, overwrite_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TRAIN, TEST, FROM_YEAR = mapping.TRAIN_WINDOW, mapping.TEST_WINDOW, mapping.NONWORK_FROM_YEAR
HALVES = (TRAIN[0], "1997-12-31"), ("1998-01-01", TRAIN[1])
QUARTER = ("1998-04-01", "1998-06-30")
_models: dict[tuple[str, str], str] = {}


def query(build: Callable[[Warehouse], DataFrame]) -> Callable[[Warehouse], DataFrame]:
    """Register a query under the name of its function."""
    QUERIES[build.__name__] = lambda spark, sf_dir: build(mapping.warehouse(spark, sf_dir))
    return build


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    """Real columns to six decimals, so that the order of a sum does not show."""
    return df.withColumns({name: F.round(name, 6) for name in names})


# ---- inputs several queries share ------------------------------------------------------------


def _extracted(source: Warehouse) -> DataFrame:
    return extract.extract_tasks(source, window=TRAIN)


def _cleaned(source: Warehouse) -> DataFrame:
    return clean.clean(_extracted(source))


def _stored(source: Warehouse) -> DataFrame:
    """Cleaned tasks over a stored extract, for operators that read their input more than once."""
    return clean.clean(stage(_extracted(source), "tasks"))


def _trimmed(source: Warehouse) -> DataFrame:
    return outliers.trim_bottom(_stored(source), tiebreak=TASK_IDS)


def _orders(source: Warehouse) -> DataFrame:
    return clean.clean(extract.extract_orders(source, window=TRAIN),
                       interval_col="orderIntervalDays")


def _test_extract(source: Warehouse) -> DataFrame:
    return extract.extract_tasks(
        source, window=TEST, start_col="originalstartDate", complete_col="originalcompleteDate",
        keep_ids=False)


def _test_cleaned(source: Warehouse) -> DataFrame:
    return clean.clean(_test_extract(source))


def _test_stored(source: Warehouse) -> DataFrame:
    return clean.clean(stage(_test_extract(source), "test-tasks"))


def _merged(source: Warehouse, form: str = "counts") -> DataFrame:
    return prepare.prepare_train(source, window=TRAIN, from_year=FROM_YEAR, form=form)


def _train(source: Warehouse) -> DataFrame:
    return configs.train_table(_merged(source))


def _test(source: Warehouse) -> DataFrame:
    return prepare.prepare_test(source, window=TEST)


def _test_rows(source: Warehouse) -> DataFrame:
    """The test rows as a stored table, for the model, which reads them more than once."""
    return stage(_test(source), "test-rows")


def _config_stats(source: Warehouse) -> DataFrame:
    return configs.config_stats(_train(source))


def _named(source: Warehouse) -> DataFrame:
    return configs.config_stats_named(
        _config_stats(source), extract.extract_task_dictionary(source))


def _looked_up(source: Warehouse) -> DataFrame:
    test = _test(source).withColumnRenamed(DAYS, "Actual")
    return configs.quantile_lookup(stage(_train(source), "train"), test)


def _fitted(source: Warehouse) -> boost.QuantileBoost:
    """The model at its default settings, fitted once per application and set of tables."""
    spark = source.tasks.sparkSession
    key = (spark.sparkContext.applicationId, source.tasks.inputFiles()[0])
    if key not in _models:
        model = boost.fit_quantile_boost(stage(_train(source), "train"))
        _models[key] = model.save(spark, stage_path(spark, "model"))
    return boost.QuantileBoost.load(spark, _models[key])


# ---- extracts, sources and sinks -------------------------------------------------------------


@query
def extract_tasks(source):
    return _extracted(source)


@query
def extract_tasks_original(source):
    return _test_extract(source)


@query
def extract_quarter_by_month(source):
    laid_out = layout.write_by_month(source, stage_path(source.orders.sparkSession, "by-month"))
    return extract.extract_tasks(laid_out, window=QUARTER)


@query
def extract_orders(source):
    return extract.extract_orders(source, window=TRAIN)


@query
def extract_cancelled(source):
    return extract.extract_cancelled_dependency(source, window=TRAIN)


@query
def nonworkdays(source):
    return extract.extract_nonworkdays(source.calendar, from_year=FROM_YEAR)


@query
def task_dictionary(source):
    return extract.extract_task_dictionary(source)


@query
def write_read_roundtrip(source):
    rows = _cleaned(source)
    path = overwrite_table(rows, stage_path(rows.sparkSession, "roundtrip"))
    return rows.sparkSession.read.parquet(path)


@query
def published_swap(source):
    """A table after two publications: the cleaned rows take the place of the extracted ones."""
    spark = source.tasks.sparkSession
    extracted = stage(_extracted(source), "tasks")
    tables = Publications(stage_path(spark, "published"))
    tables.publish("tasks", extracted)
    tables.publish("tasks", clean.clean(extracted), {"at least one day": F.col(DAYS) >= 1})
    return tables.read(spark, "tasks")


@query
def stage_counts(source):
    return prepare.stage_counts(source, window=TRAIN, from_year=FROM_YEAR)


# ---- projections and filters -----------------------------------------------------------------


@query
def project_case_insensitive(source):
    return _extracted(source).select("orderID", "taskID", "startDate", "completeDate", "workGroup")


@query
def filter_ne_null(source):
    return source.tasks.where(F.col("isinserted") != 1).select("taskid", "_id", "isinserted")


@query
def filter_not_in(source):
    return source.orders.where(text.has_text(F.col("orderAction"))).select("orderID", "orderAction")


@query
def filter_between(source):
    return source.orders.where(extract.in_window(F.col("completedate"), TRAIN)).select(
        "orderID", "completedate")


@query
def clean_tasks(source):
    return _cleaned(source)


@query
def clean_orders(source):
    return _orders(source)


@query
def clean_test(source):
    return _test_cleaned(source)


@query
def tasks_min_count(source):
    return outliers.tasks_with_rows(_stored(source))


@query
def split_jeop(source):
    plain, jeop = clean.split_by_jeop(_test_stored(source))
    parts = [df.select("orderID", "subIntID", "taskJeop", F.lit(name).alias("part"))
             for name, df in (("none", plain), ("jeop", jeop))]
    return clean.append_rows(*parts)


@query
def slice_tasks(source):
    return outliers.threshold_outliers(_trimmed(source)).where(
        (F.col("subIntervalName") == "task_0")
        & (F.col("T_projecttype") == "Mileage Reduction")
        & (F.col("orderAction") == "Grooms")
    )


@query
def slice_stats(source):
    return _named(source).where(
        (F.col("subIntervalName") == "task_0")
        & (F.col("T_projecttype") == "Mileage Reduction")
        & (F.col("orderDescription") == "Offnet Groom")
    )


@query
def distinct_tasks(source):
    return extract.extract_tasks(source, window=TRAIN, keep_ids=False)


# ---- joins -----------------------------------------------------------------------------------


@query
def star_join(source):
    types = extract.task_types(source.dictionary, source.phases, all_types=True)
    rows = extract.star_join(
        source.orders.drop("completedate"), source.attributes, source.tasks, types)
    return rows.select("sourcekey", "taskid", "orderID", "status", "subIntervalName", "phaseName",
                       "orderDescription", "creatorGroup")


@query
def calendar_interval(source):
    days = extract.with_interval(source.tasks, source.calendar, "startDate", "completeDate")
    days = extract.with_interval(
        days, source.calendar, "startDate", "completeDate", name="elapsedDays", mode="repaired")
    return days.select("taskid", "_id", "startDate", "completeDate", DAYS, "elapsedDays")


@query
def stats_backjoin_fanout(source):
    trimmed = _trimmed(source)
    joined = outliers.join_thresholds(trimmed, outliers.task_thresholds(trimmed))
    after = joined.groupBy("subIntervalName").agg(F.count(F.lit(1)).alias("rows_after"))
    before = trimmed.groupBy("subIntervalName").agg(F.count(F.lit(1)).alias("rows_before"))
    return before.join(after, "subIntervalName")


@query
def task_repeat_count(source):
    return rework.with_repeat_count(_stored(source)).select(
        "orderID", "subIntID", "taskid", "_id", "count")


@query
def business_dates(source):
    dated = rework.business_dates(
        _cleaned(source), source.calendar, from_year=FROM_YEAR)
    return dated.select(
        "orderID", "taskid", "_id", "startdate", "completedate",
        F.size("B_dates").alias("business_days"), text.joined_dates(F.col("B_dates")).alias("B_dates"))


# ---- aggregations ----------------------------------------------------------------------------


@query
def task_counts(source):
    return stats.task_group(_cleaned(source), ["subIntervalName"])


@query
def task_stats(source):
    found = stats.interval_stats(_trimmed(source), ["subIntervalName", "subIntID"])
    return _rounded(found, "mean", "std", *stats.TASK_PERCENTILES)


@query
def task_stats_v2(source):
    found = stats.interval_stats(
        _cleaned(source), ["subIntervalName", "subIntID"], percentiles=stats.CONFIG_PERCENTILES)
    return _rounded(found, "mean", "std", *stats.CONFIG_PERCENTILES)


@query
def task_stats_merged(source):
    """Statistics of the whole window from the stored histogram of its first half and the rows of
    its second."""
    keys = ["subIntervalName", "subIntID"]
    parts = [stage(stats.histogram(clean.clean(extract.extract_tasks(source, window=half)), keys),
                   "histogram") for half in HALVES]
    found = stats.histogram_stats(
        stats.merge_histograms(parts, keys), keys, percentiles=stats.CONFIG_PERCENTILES)
    return _rounded(found, "mean", "std", *stats.CONFIG_PERCENTILES)


@query
def config_stats_merged(source):
    """Statistics per configuration from the stored histograms of two halves of the orders."""
    train = stage(_train(source), "train")
    half = F.pmod(F.xxhash64("orderID"), F.lit(2))
    parts = [stage(stats.histogram(train.where(half == part), CONFIG_KEYS), "histogram")
             for part in (0, 1)]
    return configs.config_stats_of(stats.merge_histograms(parts, CONFIG_KEYS))


@query
def backoff_quantiles(source):
    levels = [list(CONFIG_KEYS), ["subIntID"], []]
    found = stats.backoff_quantiles(stage(_train(source), "train"), levels, alpha=0.75)
    return _rounded(found, "quantile")


@query
def config_stats(source):
    return _config_stats(source)


@query
def config_stats_named(source):
    return _named(source)


@query
def config_stats_wide(source):
    return configs.config_stats_wide(_merged(source))


@query
def stats_reconcile(source):
    found = stage(_config_stats(source), "config-stats")
    return configs.stats_reconcile(found, configs.config_stats_named(
        found, extract.extract_task_dictionary(source)))


@query
def task_size_split(source):
    return stats.task_size_split(stats.task_group(_cleaned(source), ["subIntervalName"]))


@query
def rare_categories(source):
    return categories.rare_categories(_orders(source))


@query
def category_nunique(source):
    return stats.n_unique(_orders(source), "categoryCD")


@query
def category_value_counts(source):
    return stats.value_counts(_orders(source), "categoryCD")


@query
def jeop_flag_counts(source):
    flagged = _merged(source).withColumn("taskJeop_flagged", numbers.jeop_flag(F.col("taskJeop")))
    return stats.value_counts(flagged, "taskJeop_flagged")


@query
def interval_describe(source):
    return stats.describe(_cleaned(source))


# ---- outliers --------------------------------------------------------------------------------


@query
def trim_bottom(source):
    return _trimmed(source)


@query
def trim_both(source):
    plain, _ = clean.split_by_jeop(_test_stored(source))
    return outliers.trim_both(plain)


@query
def p99_category(source):
    return _rounded(outliers.task_thresholds(_trimmed(source)), "percentile_99").select(
        "subIntervalName", "subIntID", "percentile_99", "Category", "Outlier_threshold")


@query
def threshold_outliers(source):
    return outliers.threshold_outliers(_trimmed(source))


# ---- sort, limit and set operations ----------------------------------------------------------


@query
def head_rework(source):
    counted = rework.with_repeat_count(_stored(source)).where(F.col("count") > 1)
    return counted.select(
        "orderID", "subIntID", "startDate", "completeDate", "taskid", "count",
    ).orderBy("orderID", "subIntID", "startDate", "completeDate", "taskid").limit(5)


@query
def union_by_name(source):
    plain, jeop = clean.split_by_jeop(_test_stored(source))
    jeop = jeop.withColumn("taskJeop_flagged", numbers.jeop_flag(F.col("taskJeop")))
    return clean.append_rows(plain, jeop)


@query
def with_cancelled(source):
    return clean.add_cancelled(
        clean.task_table(_cleaned(source)),
        extract.extract_cancelled_dependency(source, window=TRAIN))


# ---- scalar functions ------------------------------------------------------------------------


@query
def null_defaults(source):
    words = {"creatorGroup": "None", "WorkGroup": "None", "PDNOrder": "false",
             "IsBuildingAdd": "false", "QtyOfCircuits": 0}
    return source.attributes.select(
        "sourcekey", *(text.default_for_null(F.col(c), d).alias(c) for c, d in words.items()))


@query
def blank_to_none(source):
    rows = source.orders.select("sourcekey", "T_projecttype", "orderclasstype").join(
        source.attributes.select("sourcekey", "orderDescription", "Expedite"), "sourcekey")
    return rows.select(
        "sourcekey",
        text.default_for_blank(F.col("T_projecttype"), "None").alias("T_projecttype"),
        text.default_for_blank(F.col("orderclasstype"), "None", "Null").alias("orderClassType"),
        text.default_for_blank(F.col("orderDescription"), "None").alias("orderDescription"),
        text.default_for_blank(F.col("Expedite"), "N").alias("Expedite"),
        text.default_for_empty(F.col("Expedite"), "N").alias("Expedite_or_missing"),
    )


@query
def bin_rare_categories(source):
    return categories.bin_rare(_cleaned(source), categories.rare_categories(_orders(source)))


@query
def jeop_flag(source):
    return _merged(source).select(
        "orderID", "subIntID", numbers.jeop_flag(F.col("taskJeop")).alias("taskJeop_flagged"))


@query
def config_key(source):
    return _config_stats(source).select("config", "count")


@query
def round_predictions(source):
    return _looked_up(source).select(
        "orderID", "subIntID", numbers.round_half_even(F.col("Prediction")).alias("Prediction"))


# ---- rework ----------------------------------------------------------------------------------


@query
def rework_days(source):
    tasks = clean.task_table(_stored(source))
    repeated = rework.repeat_counts(tasks).where(F.col("count") > 1)
    days = rework.rework_days(tasks, source.calendar, from_year=FROM_YEAR)
    return repeated.join(days, list(rework.REPEAT_KEYS), "left").withColumn(
        "days", F.coalesce("days", F.lit(0)))


@query
def rework_merge(source):
    merged = rework.rework_merge(
        clean.task_table(_stored(source)), source.calendar, from_year=FROM_YEAR)
    return merged.withColumn("B_dates", text.joined_dates(F.col("B_dates")))


@query
def prepare_train(source):
    return _merged(source, form="dates").withColumn("B_dates", text.joined_dates(F.col("B_dates")))


@query
def prepare_test(source):
    return _test(source)


# ---- learning --------------------------------------------------------------------------------


@query
def train_table(source):
    return _train(source)


@query
def train_features(source):
    return configs.feature_table(_train(source))


@query
def test_features(source):
    return configs.feature_table(_test(source))


@query
def category_index(source):
    train = stage(_train(source), "train")
    return dictionary.encode(train, dictionary.category_dictionary(train, FEATURES), FEATURES).select(
        "orderID", "subIntID", *(f"{c}_index" for c in FEATURES))


@query
def unseen_categories(source):
    return boost.unseen_categories(_train(source), _test(source))


@query
def quantile_lookup(source):
    return _rounded(_looked_up(source), "Prediction").select(
        "orderID", *FEATURES, "Actual", "Prediction")


@query
def eval_metrics(source):
    scored = stage(_looked_up(source).select("Actual", "Prediction"), "scored")
    return _rounded(metrics.eval_metrics(scored), "rmse", "mae", "r2", "median_ae")


@query
def pinball_loss(source):
    return _rounded(metrics.pinball_loss(_looked_up(source), 0.75), "pinball_loss", "coverage")


@query
def boost_start(source):
    """Where boosting starts, and the gradients of the first round by feature and category."""
    train = stage(_train(source), "train")
    base = boost.start_value(train)
    first = boost.gradient(F.col(DAYS), F.lit(base))
    pairs = F.explode(F.array(*(
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category"))
        for c in FEATURES)))
    return train.select(pairs.alias("pair"), first.alias("gradient")).groupBy(
        "pair.feature", "pair.category").agg(
        F.lit(base).alias("base"), F.count(F.lit(1)).alias("rows"),
        F.round(F.sum("gradient"), 6).alias("gradient"))


@query
def boost_leaves(source):
    """Leaf values of the first round for a given assignment: the phase of a task as its leaf."""
    train = stage(_train(source), "train")
    residual = F.col(DAYS) - F.lit(boost.start_value(train))
    return boost.leaf_quantiles(train, leaf="PID", residual=residual)


@query
def scored_columns(source):
    """What the scored table holds besides the predictions, whatever the model."""
    model = boost.fit_quantile_boost(stage(_train(source), "train"), rounds=1)
    return boost.scored_table(model, _test_rows(source)).drop("Prediction")


@query
def quantile_boost_fit(source):
    model = _fitted(source)
    return model.leaf_table(source.tasks.sparkSession)


@query
def quantile_boost_predict(source):
    return _fitted(source).predict(_test_rows(source)).select(*TASK_COLUMNS, "Prediction")


@query
def scored_table(source):
    return boost.scored_table(_fitted(source), _test_rows(source))


@query
def run_record(source):
    spark = source.tasks.sparkSession
    model = _fitted(source)
    path = stage_path(spark, "model")
    scored = stage(boost.scored_table(model, _test_rows(source), rounded=False), "scored")
    record = boost.run_record(
        model.settings, metrics.eval_metrics(scored), model.save(spark, path))
    return boost.log_run(record, stage_path(spark, "runs"))
