import pytest
from pyspark.sql import functions as F

from taskspan.operators import extract
from taskspan.sources import tables
from taskspan.sources.stage import shared_folder, stage, stage_path


def test_jdbc_query_without_a_split():
    options = tables.jdbc_options("jdbc:x", "select 1")
    assert options["query"] == "select 1" and "dbtable" not in options


def test_jdbc_query_with_a_split_reads_in_parallel():
    split = tables.JdbcSplit("orderkey", 0, 1000, 16)
    options = tables.jdbc_options("jdbc:x", "select * from t", split)
    assert "query" not in options and options["dbtable"] == "(select * from t) q"
    assert options["numPartitions"] == "16" and options["partitionColumn"] == "orderkey"


def test_jdbc_reader_gets_the_options():
    class Reader:
        def __init__(self):
            self.seen = {}

        def format(self, name):
            self.seen["format"] = name
            return self

        def options(self, **options):
            self.seen |= options
            return self

        def load(self):
            return self.seen

    class Session:
        read = Reader()

    seen = tables.read_jdbc_query(Session(), "jdbc:x", "select 1", driver="d")
    assert seen["format"] == "jdbc" and seen["driver"] == "d" and seen["query"] == "select 1"


def test_jdbc_warehouse_splits_the_large_tables(source):
    seen = {}

    class Reader:
        def format(self, name):
            return self

        def options(self, **options):
            self.options_ = options
            return self

        def load(self):
            query = self.options_.get("query") or self.options_["dbtable"][1:-3]
            name = query.removeprefix("select * from ")
            seen[name] = self.options_
            return getattr(source, name)

    class Session:
        @property
        def read(self):
            return Reader()

    queries = {name: f"select * from {name}" for name in source._fields}
    splits = {"tasks": tables.JdbcSplit("sourcekey", 0, 10, 4)}
    read = tables.read_jdbc_warehouse(Session(), "jdbc:x", queries, splits)
    assert read.tasks is source.tasks and seen["tasks"]["numPartitions"] == "4"
    assert "query" in seen["phases"]


def test_overwrite_replaces_rows_and_schema(spark):
    path = stage_path(spark, "table")
    tables.overwrite_table(spark.range(5), path)
    tables.overwrite_table(spark.range(3).withColumn("x", F.lit("a")), path)
    assert spark.read.parquet(path).columns == ["id", "x"]
    assert spark.read.parquet(path).count() == 3


def test_overwrite_by_partition(spark):
    path = stage_path(spark, "parts")
    tables.overwrite_table(spark.range(6).withColumn("y", F.col("id") % 2), path,
                           partition_by=["y"])
    assert spark.read.parquet(path).where("y = 1").count() == 3


def test_register_and_read_by_name(spark):
    path = tables.overwrite_table(spark.range(4), stage_path(spark, "named"))
    name = "registered_tasks"
    try:
        assert tables.register_table(spark, name, path).count() == 4
        assert tables.read_table(spark, name).count() == 4
    finally:
        spark.sql(f"drop table if exists {name}")


def test_a_bucketed_task_table_is_read_by_its_buckets(spark, source):
    """The order rows are stored without buckets, so they alone are dealt anew for the join."""
    window = ("1995-01-01", "2000-12-31")
    want = extract.extract_tasks(source, window=window)
    names = {part: f"bucketed_{part}" for part in ("orders", "attributes", "tasks")}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bucketed = source._replace(**{
            part: tables.overwrite_named_table(
                getattr(source, part), name, bucket_by=(4, "sourcekey"))
            for part, name in names.items()
        })
        got = extract.extract_tasks(bucketed, window=window)
        plan = got._jdf.queryExecution().executedPlan().toString()
        scan = next(line for line in plan.splitlines() if "bucketed_tasks" in line)
        assert "SortMergeJoin [sourcekey" in plan and "Bucketed: true" in scan
        assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        for name in names.values():
            spark.sql(f"drop table if exists {name}")


def test_stage_keeps_rows_and_schema(spark):
    df = spark.range(10).withColumn("d", F.lit("1999-01-01").cast("date"))
    stored = stage(df, "rows")
    assert stored.schema.simpleString() == df.schema.simpleString()
    assert stored.exceptAll(df).isEmpty() and stored.count() == 10


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder


class Session:
    def __init__(self, master, conf, folder=None):
        self.sparkContext, self.conf = Context(master, folder), conf


@pytest.mark.parametrize("session", [
    Session("yarn", {"spark.checkpoint.dir": "hdfs:///shared/"}),
    Session("yarn", {}, "hdfs:///shared"),
])
def test_shared_folder_comes_from_the_session(session):
    assert shared_folder(session) == "hdfs:///shared"


def test_cluster_without_a_shared_folder_fails():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session("yarn", {}))
