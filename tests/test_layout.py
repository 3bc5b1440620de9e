from datetime import date

import pytest
from pyspark.sql import functions as F

from taskspan.operators import extract
from taskspan.sources import layout, mapping
from taskspan.sources.stage import stage_path

QUARTER = ("1998-04-01", "1998-06-30")


@pytest.fixture(scope="module")
def tables(spark):
    """The mapped tables with a key whose orders are in two months and one whose order has no date."""
    source = mapping.warehouse(spark, "/root/testdata/sf0.01")
    fit = extract.eligible_orders(source.orders, status="Completed", window=QUARTER)
    twice, undated = (r["sourcekey"] for r in fit.orderBy("sourcekey").limit(2).collect())
    later = source.orders.where(F.col("sourcekey") == twice).withColumn(
        "completedate", F.lit(date(2001, 7, 1)))
    orders = source.orders.withColumn("completedate", F.when(
        F.col("sourcekey") != undated, F.col("completedate"))).unionByName(later)
    return source._replace(orders=orders)


@pytest.fixture(scope="module")
def laid_out(spark, tables):
    return layout.write_by_month(tables, stage_path(spark, "laid-out"))


def same(got, want):
    return got.count() == want.count() and got.exceptAll(want).isEmpty()


def scans(node):
    """File scans of an executed plan, those of finished stages included."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        yield from scans(node.executedPlan())
    elif name.endswith("QueryStage"):
        yield from scans(node.plan())
    elif name.startswith("Scan parquet"):
        yield node
    children = node.children()
    for child in (children.apply(i) for i in range(children.length())):
        yield from scans(child)


def scan_of(df, folder):
    """The scan of one table, after its run."""
    df.collect()
    return next(s for s in scans(df._jdf.queryExecution().executedPlan())
                if s.relation().location().rootPaths().head().getName() == folder)


def test_rows_and_columns_stay(tables, laid_out):
    for name in tables._fields:
        got, want = getattr(laid_out, name), getattr(tables, name)
        assert same(got.select(want.columns), want), name


@pytest.mark.parametrize("window, mode", [
    (QUARTER, "faithful"), (QUARTER, "repaired"), (("1998-05-03", "1998-05-03"), "repaired"),
    (mapping.TRAIN_WINDOW, "faithful")])
def test_extracts_are_equal(tables, laid_out, window, mode):
    for build in (extract.extract_tasks, extract.extract_orders,
                  extract.extract_cancelled_dependency):
        want = build(tables, window=window, mode=mode)
        assert same(build(laid_out, window=window, mode=mode), want), build
    assert not extract.extract_orders(tables, window=QUARTER).isEmpty()


def test_keys_of_several_months_and_without_a_date(tables, laid_out):
    months = {r[0] for r in laid_out.tasks.select(layout.ORDER_MONTH).distinct().collect()}
    assert layout.SEVERAL in months and layout.UNDATED in months
    key = laid_out.tasks.where(F.col(layout.ORDER_MONTH) == layout.SEVERAL).first()["sourcekey"]
    for window in (QUARTER, ("2001-07-01", "2001-07-01")):
        orders = extract.eligible_orders(laid_out.orders, status="Completed", window=window)
        assert not orders.where(F.col("sourcekey") == key).isEmpty()


def test_orders_are_pruned_by_month(laid_out):
    orders = extract.eligible_orders(laid_out.orders, status="Completed", window=QUARTER)
    plan = orders._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    low = layout.MONTH in filters and str(1998 * 12 + 4) in filters
    assert low and str(1998 * 12 + 6) in filters


def test_a_quarter_reads_few_files(spark, laid_out):
    """The months of the orders reach the scan of the tasks while the query runs."""
    got = extract.extract_tasks(laid_out, window=QUARTER)
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()
    scan = scan_of(got, "tasks")
    read = scan.metrics().apply("numFiles").value()
    assert 0 < read < len(laid_out.tasks.inputFiles()) / 3


def test_tables_without_months_are_read_as_before(tables):
    orders = tables.orders.limit(3)
    assert layout.in_months(orders, QUARTER) is orders
    assert layout.beside(tables.tasks, orders).columns == tables.tasks.columns


def test_empty_tables(spark, tables):
    empty = tables._replace(**{
        name: getattr(tables, name).limit(0) for name in ("orders", "attributes", "tasks")})
    orders = layout.by_month(empty).orders
    assert orders.isEmpty() and layout.MONTH in orders.columns
    orderless = layout.by_month(tables._replace(orders=empty.orders)).tasks
    assert [r[0] for r in orderless.select(layout.ORDER_MONTH).distinct().collect()] == [
        layout.ORDERLESS]
