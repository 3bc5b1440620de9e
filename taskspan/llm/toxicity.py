"""Toxicity: boosted trees over dense features of a text, with isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskspan.llm import text as tx
from taskspan.sources.stage import stage

TRAINING_ROWS = 20_000  # labelled rows that the lexicon and the trees are fitted to, about
LEXICON = 4_096  # entries of the fitted lexicon at most
LEAST_SUPPORT = 0.005  # share of the toxic training texts that hold an entry, and 4 texts at least
LEAST_ODDS = 2.0  # log odds of an entry
NEAR = 5  # words between a lexicon word and a second person
TREES, DEPTH = 12, 4
PREFIXES = (4, 5)  # bytes: inflected forms share an entry
SEED = 11
FEATURES = ("length", "lexicon_density", "lexicon_words", "strongest", "odds_density", "near_you",
            "you_density", "capitals", "punctuation", "shouting", "obfuscation", "stretching")
INSULTS = "idiot moron scum trash loser stupid worthless pathetic disgusting clown dumb freak"
SECOND_PERSON = ("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi "
                 "ton ta tes vous votre vos tú usted ustedes ti tus vosotros")
LETTERS = tx.classes("0123456789abcdefghijklmnopqrstuvwxyz", high=1)
_SIGNS = b"!\"#$%&'*+,-./:;<=>?@[\\]^_`{|}~()"


def _hashes(words: str) -> np.ndarray:
    data = np.frombuffer(words.encode(), np.uint8)
    low = tx.lowered(data)
    starts, ends, _ = tx.tokens(low, np.array([0, len(data)]), LETTERS)
    return np.sort(tx.Rolling(low).of(starts, ends))


def entries(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Per word the hash of the word and of its prefixes, and the first word of each row."""
    low = tx.lowered(data)
    starts, ends, first = tx.tokens(low, offsets, LETTERS)
    rolling = tx.Rolling(low)
    sets = [rolling.of(starts, ends)]
    for size in PREFIXES:
        part = rolling.of(starts, np.minimum(starts + size, ends)) ^ np.uint64(size)
        sets.append(np.where(ends - starts >= size, part, np.uint64(0)))
    return sets, first


def known_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The place of each value in the sorted `table`, or -1."""
    place = np.full(len(values), -1, np.int64)
    if not len(table):
        return place
    seen = np.zeros(1 << 16, bool)
    seen[table & np.uint64(0xFFFF)] = True
    maybe = np.flatnonzero(seen[values & np.uint64(0xFFFF)])
    at = np.minimum(np.searchsorted(table, values[maybe]), len(table) - 1)
    same = table[at] == values[maybe]
    place[maybe[same]] = at[same]
    return place


def row_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(flags))[offsets])


def dense(data: np.ndarray, offsets: np.ndarray, lexicon: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """The features of each row (rows x features); a text without words has zeros."""
    sets, first = entries(data, offsets)
    words = np.diff(first)
    row = np.repeat(np.arange(len(words)), words)
    strength = np.zeros(len(row))
    for values in sets:
        place = known_in(values, lexicon)
        strength = np.maximum(strength, np.where(place >= 0, odds[place] if len(odds) else 0.0, 0.0))
    insult = known_in(sets[0], _INSULTS) >= 0
    strength = np.where(insult, np.maximum(strength, LEAST_ODDS), strength)
    hit = np.flatnonzero(strength > 0)
    you = np.flatnonzero(known_in(sets[0], _YOU) >= 0)
    near = np.zeros(len(hit), bool)
    if len(you):
        for at in (np.searchsorted(you, hit) - 1, np.minimum(np.searchsorted(you, hit), len(you) - 1)):
            other = you[np.maximum(at, 0)]
            near |= (np.abs(other - hit) <= NEAR) & (row[other] == row[hit])
    n, count = len(words), np.maximum(words, 1)
    strongest = np.zeros(n)
    np.maximum.at(strongest, row[hit], strength[hit])
    upper = (data >= 65) & (data <= 90)
    letter = (tx.lowered(data) >= 97) & (tx.lowered(data) <= 122)
    sign = _SIGN[data]
    size = np.maximum(np.diff(offsets), 1)
    inner = np.zeros(len(data), bool)
    same = np.zeros(len(data), bool)
    if len(data) > 2:
        odd = (sign & (data != 39) & (data != 45)) | ((data >= 48) & (data <= 57))
        inner[1:-1] = odd[1:-1] & letter[:-2] & letter[2:]
        same[2:] = letter[2:] & (data[2:] == data[1:-1]) & (data[2:] == data[:-2])
    hits = np.bincount(row[hit], minlength=n)
    return np.column_stack([
        np.log1p(words), hits / count, hits, strongest,
        np.bincount(row, strength, n) / count, np.bincount(row[hit][near], minlength=n) / count,
        np.bincount(row[you], minlength=n) / count, row_sums(upper, offsets) / size,
        row_sums(sign, offsets) / size, row_sums(data == 33, offsets) / size,
        row_sums(inner, offsets) / count, row_sums(same, offsets) / count])


_INSULTS, _YOU = _hashes(INSULTS), _hashes(SECOND_PERSON)
_SIGN = tx.classes(_SIGNS) > 0


def held_out() -> Column:
    """True for the rows that nothing is learnt from; a null doc_id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def training(docs: DataFrame, labels: DataFrame, most_rows: int = TRAINING_ROWS) -> DataFrame:
    """text and toxic of about `most_rows` labelled rows that are not held out, drawn by hash.

    Null labels don't count; of a doc_id's labels the largest does. The drawn labels are broadcast:
    their number is bounded by `most_rows`.
    """
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out()).groupBy(
        "doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, most_rows / max(1, labels.count()))
    drawn = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    sample = known.filter(drawn).select(F.col("doc_id").alias("_labelled"), "toxic")
    return docs.select("doc_id", "text").join(
        F.broadcast(sample), F.col("doc_id") == F.col("_labelled")).select("text", "toxic")


def fit_lexicon(rows: DataFrame, most: int = LEXICON) -> tuple[np.ndarray, np.ndarray]:
    """Words and prefixes that toxic texts hold more often: sorted hashes and their log odds.

    Texts are counted, not words, and copies of a text once. The `most` strongest entries come to
    the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.flat(batch.column(0))
            toxic = batch.column(1).to_numpy(zero_copy_only=False) > 0
            for low, high in tx.slices(offsets):
                at = offsets[low:high + 1] - offsets[low]
                sets, first = entries(data[offsets[low]:offsets[high]], at)
                row = np.repeat(np.arange(high - low), np.diff(first))
                found = np.concatenate(sets)
                where = np.tile(row, len(sets))
                order = np.lexsort((where, found))
                found, where = found[order], where[order]
                new = np.append(True, (found[1:] != found[:-1]) | (where[1:] != where[:-1]))
                new = new[:len(found)] & (found != 0)
                values, index = np.unique(found[new], return_inverse=True)
                bad = toxic[low:high][where[new]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values.view(np.int64)),
                     pa.array(np.bincount(index[bad], minlength=len(values))),
                     pa.array(np.bincount(index[~bad], minlength=len(values)))],
                    ["entry", "toxic", "other"])

    texts = rows.groupBy(F.xxhash64("text").alias("h")).agg(
        F.first("text").alias("text"), F.max("toxic").alias("toxic")).drop("h")
    texts = stage(texts, "lexicon_texts")
    toxic, total = texts.agg(F.count_if(F.col("toxic") > 0), F.count(F.lit(1))).first()
    if not toxic or toxic == total:
        return np.zeros(0, np.uint64), np.zeros(0)
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log(
        (F.col("other") + 0.5) / (total - toxic + 1.0))
    best = texts.mapInArrow(count, "entry long, toxic long, other long").groupBy("entry").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).filter(
        F.col("toxic") >= max(4, LEAST_SUPPORT * toxic)).withColumn("odds", odds).filter(
        F.col("odds") >= LEAST_ODDS).orderBy(F.desc("odds"), F.desc("toxic"), "entry").limit(most)
    found = sorted((np.int64(r["entry"]).view(np.uint64), r["odds"]) for r in best.collect())
    return np.array([e for e, _ in found], np.uint64), np.array([o for _, o in found])


def with_features(docs: DataFrame, lexicon: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """`docs` (with a column text) without the text and with the features."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # at most LEXICON entries
    text = docs.columns.index("text")
    rest = [k for k in range(len(docs.columns)) if k != text]
    kinds = T.StructType([*(docs.schema.fields[k] for k in rest),
                          *(T.StructField(f, T.DoubleType()) for f in FEATURES)])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, odds = shared.value
        for batch in batches:
            data, offsets = tx.flat(batch.column(text))
            out = np.zeros((batch.num_rows, len(FEATURES)))
            for low, high in tx.slices(offsets):
                at = offsets[low:high + 1] - offsets[low]
                out[low:high] = dense(data[offsets[low]:offsets[high]], at, table, odds)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in rest), *(pa.array(c) for c in out.T.copy())],
                names=kinds.names)

    return docs.mapInArrow(features, kinds)


@dataclass
class ToxicityModel:
    """A fitted lexicon, boosted trees and the calibration of their probabilities.

    Without labels of both kinds there are no trees, and every score is the share of toxic labels.
    """

    lexicon: tuple[np.ndarray, np.ndarray]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    share: float

    def score(self, docs: DataFrame) -> DataFrame:
        """`docs` (with a column text) with a column score behind its other columns; no text."""
        rows = with_features(docs, self.lexicon)
        kept = [c for c in rows.columns if c not in FEATURES]
        if self.trees is None:
            return rows.select(*kept, F.lit(self.share).alias("score"))
        rows = _raw(self.trees, _vectors(rows, kept))
        rows = self.calibration.transform(rows)
        return rows.select(*kept, F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"))


def _vectors(rows: DataFrame, kept: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select(
        *kept, "features")


def _raw(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    scored = trees.transform(rows)
    return scored.withColumn("raw", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction")


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = TRAINING_ROWS, trees: int = TREES,
        depth: int = DEPTH) -> ToxicityModel:
    """Fit to a bounded sample of the labelled rows that are not held out.

    The lexicon and the trees see three quarters of it, the calibration the rest, split by a hash of
    the text so that copies stay together.
    """
    rows = stage(training(docs, labels, most_rows).withColumn(
        "part", F.pmod(F.xxhash64(F.lit(SEED), "text"), F.lit(4))), "labelled")
    toxic, total = rows.agg(F.count_if(F.col("toxic") > 0), F.count(F.lit(1))).first()
    fitted = rows.filter("part > 0").select("text", "toxic")
    lexicon = fit_lexicon(fitted)
    share = toxic / total if total else 0.0
    table = stage(with_features(rows, lexicon).withColumn(
        "label", (F.col("toxic") > 0).cast("double")).coalesce(8), "training_features")
    kinds = {(r["fit"], r["label"]) for r in table.select(
        (F.col("part") > 0).alias("fit"), "label").distinct().collect()}
    if len(kinds) < 4:
        return ToxicityModel(lexicon, None, None, share)
    vectors = _vectors(table, ["label", "part"])
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=SEED).fit(
        vectors.filter("part > 0"))
    rest = _raw(model, vectors.filter("part = 0"))
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(rest)
    return ToxicityModel(lexicon, model, calibration, share)


def scored(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `docs`.

    Only the text takes part in a score. Null and empty texts have no words and get the score of
    such a text. Repeated rows get equal scores. Extra columns are left out.
    """
    model = fit(docs, labels, **settings)
    rows = model.score(docs.select("doc_id", held_out().alias("held_out"), "text"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
