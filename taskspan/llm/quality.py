"""Quality classifier by importance resampling: target and raw n-gram models, Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskspan.llm import text as tx
from taskspan.llm.columns import apart
from taskspan.llm.ordering import ranked
from taskspan.sources.stage import stage

BUCKETS = 1 << 14
PRIOR = 3.0  # n-grams per bucket by which the target model is drawn to the raw one
TRAINING_ROWS = 200_000  # labels used, at most about so many
SEED = 5
_BYTES = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
TOKENS = tx.classes("0123456789abcdefghijklmnopqrstuvwxyz", _BYTES, high=1)


def ngrams(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, and the row of each one.

    They are the word and punctuation unigrams, the bigrams, and one n-gram that stands for a token
    said twice in a row, whichever it is.
    """
    low = tx.lowered(data)
    starts, ends, first = tx.tokens(low, offsets, TOKENS)
    unigram = tx.Rolling(low).of(starts, ends)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    inside = row[1:] == row[:-1]
    left, right = unigram[:-1][inside], unigram[1:][inside]
    pair = np.where(left == right, np.uint64(1), tx.mixed(left * np.uint64(3) + right))
    both = np.concatenate([unigram, pair])
    return (both % np.uint64(buckets)).astype(np.int64), np.concatenate([row, row[1:][inside]])


def labelled(docs: DataFrame, labels: DataFrame, most_rows: int = TRAINING_ROWS) -> DataFrame:
    """`docs` with _target (labelled good, to fit to) and _held (0 or 1: label kept for the cut).

    About `most_rows` labels are used, drawn by a hash of the doc_id; that many fit a broadcast. One
    in five is held out. Null labels don't count; of a doc_id's labels the largest does.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.max("quality").alias("_quality"))
    share = min(1.0, most_rows / max(1, labels.count()))
    drawn = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    sample = known.filter(drawn).select(
        F.col("doc_id").alias("_labelled"),
        (~held & (F.col("_quality") > 0)).alias("_target"),
        F.when(held, F.col("_quality")).alias("_held"))
    return docs.join(F.broadcast(sample), F.col("doc_id") == F.col("_labelled"), "left").drop("_labelled")


def counts(docs: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each bucket occurs in `text` of the _target rows and of all rows; each task sends
    one count per bucket and kind, and the driver receives that much once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * buckets, np.int64)
        for batch in batches:
            data, offsets = tx.flat(batch.column(0))
            target = np.array([bool(x) for x in batch.column(1).to_pylist()], bool)
            for low, high in tx.slices(offsets):
                at = offsets[low:high + 1] - offsets[low]
                found, row = ngrams(data[offsets[low]:offsets[high]], at, buckets)
                found += buckets * (~target[low:high])[row]
                total += np.bincount(found, minlength=2 * buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    out = np.zeros(2 * buckets)
    rows = docs.select("text", "_target").mapInArrow(count, "bucket long, n long")
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out[:buckets], out[:buckets] + out[buckets:]


def log_ratio(target: np.ndarray, raw: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """Log of the target model's probability of each bucket over the raw model's.

    The target model is drawn to the raw one by `prior` n-grams per bucket: a bucket the target
    sample is too small to hold says nothing, one it should hold often and never does says much.
    """
    expected = raw * (target.sum() / max(raw.sum(), 1.0))
    return np.log((target + prior) / (expected + prior))


def gumbel(seed: int, *columns: str) -> Column:
    """A standard Gumbel number per row, fixed by the seed and the row's values."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)
    return -F.log(-F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))))


def weighed(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """`docs` with _log_weight (sum of the log ratios of the whole text's n-grams) and _key (with
    Gumbel noise) behind its columns."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # one number per bucket
    text = docs.columns.index("text")
    kinds = T.StructType([*docs.schema.fields, T.StructField("_log_weight", T.DoubleType())])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            data, offsets = tx.flat(batch.column(text))
            weight = np.zeros(batch.num_rows)
            for low, high in tx.slices(offsets):
                at = offsets[low:high + 1] - offsets[low]
                found, row = ngrams(data[offsets[low]:offsets[high]], at, len(table))
                weight[low:high] = np.bincount(row, table[found], high - low)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(weight)], [*batch.schema.names, "_log_weight"])

    return docs.mapInArrow(weigh, kinds).withColumn(
        "_key", F.col("_log_weight") + gumbel(SEED, "doc_id", "text"))


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The weight that splits the held-out labels with the fewest errors, in the middle of the gap;
    minus infinity if there aren't both kinds."""
    if good.all() or not good.any():
        return float("-inf")
    order = np.argsort(weights, kind="stable")
    weights, good = weights[order], good[order]
    wrong = np.append(0, np.cumsum(good)) + (~good).sum() - np.append(0, np.cumsum(~good))
    least = np.flatnonzero(wrong == wrong.min())
    at = int(least[len(least) // 2])
    if at == 0:
        return float("-inf")
    return float((weights[at - 1] + weights[min(at, len(weights) - 1)]) / 2)


def resampled(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR,
              most_rows: int = TRAINING_ROWS) -> tuple[DataFrame, np.ndarray, float]:
    """(doc_id, log_weight, key, kept) per row as a stored table, the log ratios and the least key.

    The target model is fitted to labelled good documents, the raw model to all documents. A
    document's weight is the ratio of the two, and Gumbel noise on its log makes the k largest keys
    a sample without replacement in proportion to the weights. k is the number of documents whose
    weight is above the cut that best splits the held-out labels. Rows that tie with the k-th stay.

    A null or empty text has weight 0, as it says nothing against the target. Repeated rows have the
    same key and the same fate. A held-out label counts once, however many rows have its doc_id, with
    the largest of their weights. Without labels of both kinds everything is kept. Extra columns, also
    ones called like the new ones, are left out.
    """
    plain = docs.select("doc_id", "text")
    known = labelled(plain, labels, most_rows)
    target, raw = counts(known, buckets)
    ratio = log_ratio(target, raw, prior)
    rows = stage(weighed(known.drop("_target"), ratio).select(
        "doc_id", F.col("_log_weight").alias("log_weight"), F.col("_key").alias("key"), "_held"),
        "weights")
    held = rows.filter("_held is not null").groupBy("doc_id").agg(
        F.max("log_weight").alias("log_weight"), F.max("_held").alias("_held")).collect()  # bounded sample
    cut = best_cut(np.array([r["log_weight"] for r in held]), np.array([r["_held"] > 0 for r in held], bool))
    wanted, total = rows.agg(F.count_if(F.col("log_weight") >= F.lit(cut)), F.count(F.lit(1))).first()
    least = float("-inf")
    if wanted < total:
        place = ranked(rows.select("key"), [F.col("key").desc()], name="place")
        last = place.filter(F.col("place") == wanted - 1).first()
        least = last["key"] if last else float("inf")
    return rows.drop("_held").withColumn("kept", F.col("key") >= F.lit(least)), ratio, least


def good_documents(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows and columns of `docs` that the resampling keeps."""
    _, ratio, least = resampled(docs, labels, **settings)
    kept = weighed(apart(docs, "doc_id", "text"), ratio).filter(F.col("_key") >= F.lit(least)).drop("_log_weight", "_key")
    return kept.toDF(*docs.columns)
