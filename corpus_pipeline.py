"""The corpus pipeline: raw documents to shards of a mixed, clean corpus, by five of the operators.

Each stage takes (spark, docs, sf_dir) and returns all rows it keeps, with the columns of documents;
the last one returns where each row goes. Stages are written as Parquet and read again in between,
so a lost executor costs part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskspan.llm import decontaminate, mixing, near, quality, sharding
from taskspan.sources.stage import stage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling keeps."""
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of alike texts, the one with the smallest doc_id."""
    return near.deduplicated(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; mostly covered ones go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of the sources takes it."""
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document of the mix."""
    return sharding.shard_documents(docs).withColumns({
        "law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", no_benchmark),
    ("mix", mix_sources),
    ("shard", shards),
]

#: The classifier and the near-duplicate search have no SQL form; tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
