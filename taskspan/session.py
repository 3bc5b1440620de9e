"""Session settings for runs that build their own session (tests, bench)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int = 8, app: str = "taskspan", memory: str = "12g") -> SparkSession:
    """A local session; on a cluster, use the session the cluster provides instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
