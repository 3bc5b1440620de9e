"""Table readers and writers."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from taskspan.schema import SOURCE_SCHEMAS, check_schema


class Warehouse(NamedTuple):
    """The six source tables the extracts read."""

    orders: DataFrame
    attributes: DataFrame
    tasks: DataFrame
    dictionary: DataFrame
    phases: DataFrame
    calendar: DataFrame

    def checked(self) -> "Warehouse":
        for name, df in self._asdict().items():
            check_schema(df, SOURCE_SCHEMAS[name], name)
        return self


class JdbcSplit(NamedTuple):
    """How a JDBC read is cut into parallel range queries."""

    column: str
    lower: str | int
    upper: str | int
    partitions: int


def jdbc_options(url: str, query: str, split: JdbcSplit | None = None,
                 fetch_size: int = 10_000) -> dict[str, str]:
    """Reader options for a query; with `split`, one range query per partition.

    Spark rejects `query` together with partition options, so a split read passes the query as a
    derived table. Without a split the whole result arrives through one task.
    """
    options = {"url": url, "fetchsize": str(fetch_size)}
    if split is None:
        return options | {"query": query}
    return options | {
        "dbtable": f"({query}) q",
        "partitionColumn": split.column,
        "lowerBound": str(split.lower),
        "upperBound": str(split.upper),
        "numPartitions": str(split.partitions),
    }


def read_jdbc_query(spark: SparkSession, url: str, query: str, split: JdbcSplit | None = None,
                    **extra: str) -> DataFrame:
    """Run a query on a JDBC warehouse and read its result."""
    return spark.read.format("jdbc").options(**jdbc_options(url, query, split), **extra).load()


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """Read a catalog table."""
    return spark.table(name)


def read_warehouse(spark: SparkSession, names: dict[str, str]) -> Warehouse:
    """Read the six source tables by their catalog names."""
    return Warehouse(**{part: read_table(spark, names[part]) for part in Warehouse._fields}).checked()


def read_jdbc_warehouse(spark: SparkSession, url: str, queries: dict[str, str],
                        splits: dict[str, JdbcSplit], **extra: str) -> Warehouse:
    """Read the six source tables over JDBC; the joins of the extracts then run in Spark.

    Give a split for every table that is not small, so that it is read by parallel range queries.
    """
    return Warehouse(**{
        part: read_jdbc_query(spark, url, queries[part], splits.get(part), **extra)
        for part in Warehouse._fields
    }).checked()


def overwrite_table(df: DataFrame, path: str, fmt: str = "parquet",
                    partition_by: Sequence[str] = ()) -> str:
    """Replace the table at `path`, schema included, and return the path.

    Delta needs `overwriteSchema` for a changed schema; file formats replace the files anyway.
    """
    writer = df.write.format(fmt).mode("overwrite")
    if fmt == "delta":
        writer = writer.option("overwriteSchema", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def overwrite_named_table(df: DataFrame, name: str, fmt: str = "parquet",
                          bucket_by: tuple[int, str] | None = None) -> DataFrame:
    """Replace a catalog table and return it.

    `bucket_by` gives a number of buckets and a column. Orders, attributes and tasks bucketed alike
    by `sourcekey` join in the extracts without a shuffle.
    """
    writer = df.write.format(fmt).mode("overwrite")
    if bucket_by:
        buckets, column = bucket_by
        writer = writer.bucketBy(buckets, column).sortBy(column)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def register_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """Name the files at `path` as an external catalog table and return it.

    A table of that name is set to the new place in one step, so that there is no moment without it;
    only if its columns or its format change is it dropped and made anew. The files themselves are
    not touched.
    """
    if spark.catalog.tableExists(name) and _like(spark, name, path, fmt):
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
    else:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(f"CREATE TABLE {name} USING {fmt} LOCATION '{path}'")
    spark.catalog.refreshTable(name)
    return spark.table(name)


def _like(spark: SparkSession, name: str, path: str, fmt: str) -> bool:
    """Whether an external catalog table has the format and the columns of the files at `path`."""
    told = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
    return (told.get("Type") == "EXTERNAL" and (told.get("Provider") or "").lower() == fmt.lower()
            and _columns(spark.table(name)) == _columns(spark.read.format(fmt).load(path)))


def _columns(df: DataFrame) -> list[tuple[str, str]]:
    return [(field.name, field.dataType.simpleString()) for field in df.schema]


class FailedCheck(ValueError):
    """A publication that was written but not made visible."""


PUBLICATIONS = "table string, path string, rows long, published_at long"


class Publications:
    """Tables under a folder that are replaced by write, check and swap.

    Every publication of a table is a folder of its own. It is read back and checked, and only then
    does one appended row of the list of publications make it the present one and the catalog name,
    if there is a database, point to it. A publication that fails leaves the one before in place, and
    a reader under way keeps the files it began with, as older folders stay until `prune`.
    """

    def __init__(self, folder: str, *, fmt: str = "parquet", database: str | None = None) -> None:
        self.folder, self.fmt, self.database = folder.rstrip("/"), fmt, database

    def publish(self, name: str, df: DataFrame, checks: Mapping[str, Column | str] | None = None
                ) -> DataFrame:
        """Write a table, check it and make it the present one.

        The written files must have the columns of `df` and as many rows as were written; both come
        at no further pass over `df`. `checks` are conditions by name which no written row may fail
        (a missing value is no failure); they cost one pass over the written files.
        """
        spark, path = df.sparkSession, f"{self.folder}/{name}/{uuid.uuid4().hex}"
        passed = Observation(f"published-{uuid.uuid4().hex}")
        overwrite_table(df.observe(passed, F.count(F.lit(1)).alias("rows")), path, self.fmt)
        found = spark.read.format(self.fmt).load(path)
        if _columns(found) != _columns(df):
            raise FailedCheck(f"{name}: columns {_columns(found)} in place of {_columns(df)}")
        failed = [F.count_if(~(F.expr(one) if isinstance(one, str) else one)).alias(f"not {label}")
                  for label, one in (checks or {}).items()]
        told = found.agg(F.count(F.lit(1)).alias("rows"), *failed).first().asDict()
        rows = told.pop("rows")
        if rows != passed.get["rows"]:
            raise FailedCheck(f"{name}: {rows} rows in place of {passed.get['rows']}")
        if any(told.values()):
            raise FailedCheck(f"{name}: " + ", ".join(f"{n} rows {k}" for k, n in told.items() if n))
        spark.createDataFrame([(name, path, rows, time.time_ns())], PUBLICATIONS).coalesce(1).write.mode(
            "append").json(f"{self.folder}/publications")
        if self.database:
            return register_table(spark, f"{self.database}.{name}", path, self.fmt)
        return found

    def history(self, spark: SparkSession) -> DataFrame:
        """All publications: table, path, rows and time in nanoseconds."""
        return spark.read.schema(PUBLICATIONS).json(f"{self.folder}/publications")

    def present(self, spark: SparkSession) -> DataFrame:
        """The last publication of every table; its row count was taken while it was written."""
        last = F.max_by(F.struct("path", "rows", "published_at"), F.struct("published_at", "path"))
        return self.history(spark).groupBy("table").agg(last.alias("last")).select("table", "last.*")

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """The table as it was published last."""
        row = self.present(spark).where(F.col("table") == name).first()
        if row is None:
            raise LookupError(f"{name} has not been published under {self.folder}")
        return spark.read.format(self.fmt).load(row["path"])

    def prune(self, spark: SparkSession, name: str, keep: int = 2) -> int:
        """Delete all but the last `keep` publications of a table; returns how many folders went.

        Readers that began before those must have ended. Their rows stay in the history.
        """
        if keep < 1:
            raise ValueError("the present publication is kept")
        order = self.history(spark).where(F.col("table") == name).orderBy(F.desc("published_at"), "path")
        gone = 0
        for row in order.offset(keep).toLocalIterator():
            path = spark._jvm.org.apache.hadoop.fs.Path(row["path"])
            gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        return gone
