"""Stored intermediate results.

A stage is a parquet table in the folder the cluster names in `spark.checkpoint.dir`. It cuts the
lineage, survives the loss of executors, is read with column pruning, and has a file size that
Catalyst knows: a small stage is broadcast by the planner's own size check and a large one is not.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_counts: ContextVar[dict[str, Observation] | None] = ContextVar("counts", default=None)
_run: ContextVar[str] = ContextVar("run", default="")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a session in one process without one gets a scratch
    folder."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    return context.getCheckpointDir().rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/stages/{app}/{_run.get()}{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` under the shared folder and return the stored table."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def counted_rows() -> Iterator[dict[str, Observation]]:
    """Rows that `counted` sees inside, by step. They are there once what was marked is written."""
    found: dict[str, Observation] = {}
    token = _counts.set(found)
    try:
        yield found
    finally:
        _counts.reset(token)


def counted(df: DataFrame, step: str, **conditions: Column) -> DataFrame:
    """Count the rows of a step, and those that meet conditions, as they pass on to be written.

    Inside `counted_rows` only; elsewhere `df` is left as it is. The step must be read whole by
    exactly one write. Columns that the write does not need are no longer pruned below this point.
    Counts of a step in the last Spark stage of its write are exact; one before a further shuffle may
    count rows again that a lost executor makes Spark compute again.
    """
    found = _counts.get()
    if found is None:
        return df
    found[step] = Observation(step)
    return df.observe(found[step], F.count(F.lit(1)).alias(step), *(
        F.count_if(condition).alias(name) for name, condition in conditions.items()))


@contextmanager
def run_stages(spark: SparkSession) -> Iterator[None]:
    """Delete the stages that are written inside once it ends; nothing may read them after that."""
    folder = f"run-{uuid.uuid4().hex}/"
    token = _run.set(_run.get() + folder)
    try:
        top = f"{shared_folder(spark)}/stages/{spark.sparkContext.applicationId}/{_run.get()}"
        yield
    finally:
        _run.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
