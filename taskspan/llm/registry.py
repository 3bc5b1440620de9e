"""Queries over the test tables, each through its operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskspan.llm import (
    archives, decontaminate, mixing, near, oracles, packing, pii, quality, repeats, sharding, toxicity,
    treap, trie, vectors)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_linked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.linked_vectors(_table(spark, sf_dir, "embeddings"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, _ = quality.resampled(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return rows


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.marked(_table(spark, sf_dir, "documents")).drop("doc")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op9_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_documents(_table(spark, sf_dir, "documents"))
    return rows.withColumns({
        "law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op10_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archived(_table(spark, sf_dir, "pages"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treap.ranked_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # vocabulary files beside the library, not in it

    return packing.encoded(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_linked_vectors": op1_linked_vectors,
    "op2_quality": op2_quality,
    "op3_decontaminate": op3_decontaminate,
    "op4_mix_sources": op4_mix_sources,
    "op5_repeats": op5_repeats,
    "op6_toxicity": op6_toxicity,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_pii": op8_pii,
    "op9_ring_shards": op9_ring_shards,
    "op10_archives": op10_archives,
    "op11_ranked_search": op11_ranked_search,
    "op12_token_ids": op12_token_ids,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = dict(oracles.ORACLES)
