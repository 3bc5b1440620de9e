"""Exact repeats of long byte strings, by sparse suffix arrays in a logarithmic index family.

A suffix is indexed where a gram of the string has the smallest hash of all grams in some window of
`length` bytes. Equal windows choose the same place, so any repeated window is found through a pair of
indexed suffixes with equal head grams, while only about one position in 64 is indexed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskspan.llm import text as tx
from taskspan.sources.stage import stage

LENGTH = 200
BATCHES = 4
GROUP_CLASSES = 2_048  # contexts of one head gram that a task compares; more are compared by window
_PLACE = np.uint64(0xFFFFFFFF)

KEY = ["doc", "mark"]
SUFFIXES = "doc long, mark long, at int, windows long, head long, context long"


def reach(length: int) -> int:
    """Grams that take part in the choice of one window: the largest power of two that leaves grams
    of at least a third of the window."""
    return 1 << int(np.log2(max(length * 2 / 3, 1)))


def chosen(data: np.ndarray, offsets: np.ndarray, length: int
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Indexed suffixes: row, place, first and last window start that choose it (all in `data`), and
    the hash of the head gram."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, np.zeros(0, np.uint64)
    span = reach(length)
    gram = length - span + 1
    starts = np.arange(len(data) - gram + 1)
    hashes = tx.Rolling(data).of(starts, starts + gram)
    least = (hashes & ~_PLACE) | starts.astype(np.uint64)  # ties go to the first place
    step = 1
    while step < span:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    place = (least & _PLACE).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(place)]
    inside = np.arange(len(place)) + length <= offsets[row + 1]
    new = np.append(True, (place[1:] != place[:-1]) | (row[1:] != row[:-1]))
    first = np.flatnonzero(inside & new)
    old = np.append(new[1:] | ~inside[1:], True)
    last = np.flatnonzero(inside & old)
    return row[first], place[first], first, last, hashes[place[first]]


def suffixes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The indexed suffixes of every text: its key, place in the text, how many bytes before the place
    the first and the last window that choose it start (`windows`, see `_before`), and hashes of the
    head gram and of the context, which is all bytes of those windows. `docs` is as from `keyed`."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            data, offsets = tx.flat(batch.column(2))
            for low, high in tx.slices(offsets):
                at = offsets[low:high + 1] - offsets[low]
                part = data[offsets[low]:offsets[high]]
                row, place, first, last, head = chosen(part, at, length)
                context = tx.mixed(tx.Rolling(part, seed=2).of(first, last + length)
                                   + (place - first).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[low + row], pa.int64()), pa.array(marks[low + row], pa.int64()),
                    pa.array((place - at[row]).astype(np.int32)),
                    pa.array((place - first) * length + place - last),
                    pa.array(head.view(np.int64)), pa.array(context.view(np.int64))],
                    ["doc", "mark", "at", "windows", "head", "context"])

    return docs.select(*KEY, "text").mapInArrow(index, SUFFIXES)


def _before(length: int) -> tuple[Column, Column]:
    """How many bytes before a place its first and its last window start; both are under `length`
    and share a column, which saves a shuffled word per suffix."""
    last = F.col("windows") % length
    return ((F.col("windows") - last) / length).cast("int"), last


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text (null: empty) under a key of the content, doc_id and 64 bits of the text.

    A number by place would change with the splits of a later scan; this key does not. Rows that
    agree in doc_id and text share it, and what is found for one holds for the other.
    """
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("doc"),
        F.xxhash64(text, F.col("doc_id").isNull()).alias("mark"), "doc_id", text.alias("text"))


class IndexFamily:
    """Levels of sorted suffix heads; level k holds 2^k batches.

    A new batch is merged against every level, which gives the heads that it shares with earlier
    batches; then equal levels are merged into the next, so a head is rewritten as often as the
    logarithm of the number of batches. `repeated` has all heads that occur more than once so far.
    """

    def __init__(self):
        self.levels: dict[int, DataFrame] = {}
        self._repeated: list[DataFrame] = []

    def add(self, batch: DataFrame) -> None:
        run = stage(self._sorted(batch.groupBy("head").agg(F.count(F.lit(1)).alias("n"))), "suffix_run")
        shared = run.filter("n > 1").select("head")
        for level in self.levels.values():
            shared = shared.unionAll(run.select("head").hint("merge").join(level, "head", "left_semi"))
        self._repeated.append(stage(shared.distinct(), "repeated_heads"))
        size = 0
        while size in self.levels:
            both = self.levels.pop(size).unionAll(run)
            run = stage(self._sorted(both.groupBy("head").agg(F.sum("n").alias("n"))), "suffix_level")
            size += 1
        self.levels[size] = run

    @staticmethod
    def _sorted(heads: DataFrame) -> DataFrame:
        return heads.sortWithinPartitions("head")

    def repeated(self) -> DataFrame:
        found = self._repeated[0]
        for more in self._repeated[1:]:
            found = found.unionAll(more)
        return found.distinct()


def _window_hashes(contexts: list[bytes], before: np.ndarray, head: np.ndarray, length: int
                   ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of the contexts: its hash (with place and head), class number and start."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    offsets = np.append(0, np.cumsum([len(c) for c in contexts]))
    counts = np.diff(offsets) - length + 1
    number = np.repeat(np.arange(len(contexts)), counts)
    shift = np.arange(len(number)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[number] + shift
    value = tx.Rolling(data).of(start, start + length)
    return tx.mixed(value + head.view(np.uint64)[number]
                    + (before[number] - shift).astype(np.uint64)), number, shift


def _runs(numbers: np.ndarray, shifts: np.ndarray) -> dict[int, list[dict[str, int]]]:
    """Runs of neighbouring window starts for each class number."""
    order = np.lexsort((shifts, numbers))
    numbers, shifts = numbers[order], shifts[order]
    new = np.append(True, (numbers[1:] != numbers[:-1]) | (shifts[1:] != shifts[:-1] + 1))
    at = np.flatnonzero(new[:len(numbers)])
    out: dict[int, list[dict[str, int]]] = {}
    for low, high in zip(at.tolist(), np.append(at[1:], len(numbers)).tolist()):
        out.setdefault(int(numbers[low]), []).append(
            {"first": int(shifts[low]), "last": int(shifts[high - 1])})
    return out


RUNS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()),
                                 T.StructField("last", T.IntegerType())]))
_ARROW_RUNS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _compare_groups(classes: DataFrame, length: int) -> DataFrame:
    """Windows that classes with equal heads share, for heads with a bounded number of classes.

    Rows come sorted by head; a head is worked on when all its rows are there.
    """
    kinds = T.StructType([T.StructField("head", T.LongType()), T.StructField("context", T.LongType()),
                          T.StructField("runs", RUNS)])

    def shared(rows: pa.Table) -> pa.RecordBatch:
        head = rows["head"].to_numpy()
        value, number, shift = _window_hashes(
            rows["bytes"].to_pylist(), rows["before"].to_numpy(), head, length)
        _, index, count = np.unique(value, return_inverse=True, return_counts=True)
        twice = count[index] > 1
        runs = _runs(number[twice], shift[twice])
        hit = np.array(sorted(runs), np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array(head[hit]), pa.array(rows["context"].to_numpy()[hit]),
            pa.array([runs[k] for k in hit.tolist()], _ARROW_RUNS)], ["head", "context", "runs"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP_CLASSES):
                part = pa.Table.from_batches([batch.slice(at, GROUP_CLASSES)])
                waiting = part if waiting is None else pa.concat_tables([waiting, part])
                head = waiting["head"].to_numpy()
                whole = int(np.searchsorted(head, head[-1]))
                if whole:
                    yield shared(waiting.slice(0, whole))
                    waiting = waiting.slice(whole)
        if waiting is not None and waiting.num_rows:
            yield shared(waiting)

    return classes.select("head", "context", "before", "bytes").repartition("head").sortWithinPartitions(
        "head").mapInArrow(compare, kinds)


def _compare_windows(classes: DataFrame, length: int) -> DataFrame:
    """The same for heads with any number of classes: one row per window, counted over the cluster."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP_CLASSES):
                rows = batch.slice(at, GROUP_CLASSES)
                head = rows.column("head").to_numpy()
                value, number, shift = _window_hashes(
                    rows.column("bytes").to_pylist(), rows.column("before").to_numpy(), head, length)
                yield pa.RecordBatch.from_arrays([
                    pa.array(head[number]), pa.array(rows.column("context").to_numpy()[number]),
                    pa.array(shift.astype(np.int32)), pa.array(value.view(np.int64))],
                    ["head", "context", "shift", "value"])

    rows = stage(classes.select("head", "context", "before", "bytes").mapInArrow(
        explode, "head long, context long, shift int, value long"), "windows")
    twice = stage(rows.groupBy("value").agg(
        F.min("context").alias("a"), F.max("context").alias("b")).filter("a <> b").select("value"),
        "shared_windows")
    found = rows.join(twice, "value")
    return found.groupBy("head", "context").agg(F.transform(
        F.array_sort(F.collect_list("shift")), lambda s: F.struct(s.alias("first"), s.alias("last"))
    ).alias("runs"))


def _contexts(docs: DataFrame, classes: DataFrame, length: int) -> DataFrame:
    """`classes` with the bytes of their contexts, cut out of the text of one document each.

    Equal rows share a key, so each may give the cut; one is left.
    """
    wanted = classes.groupBy(*KEY).agg(F.collect_list(F.struct(
        "at", "before", "least", "head", "context", "hot")).alias("cuts"))
    kinds = "head long, context long, before int, hot boolean, bytes binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column(0)[row].as_buffer().to_pybytes()
                cuts = batch.column(1)[row].as_py()
                yield pa.RecordBatch.from_arrays([
                    pa.array([c["head"] for c in cuts], pa.int64()),
                    pa.array([c["context"] for c in cuts], pa.int64()),
                    pa.array([c["before"] for c in cuts], pa.int32()),
                    pa.array([c["hot"] for c in cuts], pa.bool_()),
                    pa.array([text[c["at"] - c["before"]:c["at"] - c["least"] + length] for c in cuts],
                             pa.binary())], ["head", "context", "before", "hot", "bytes"])

    return docs.select(*KEY, F.col("text").cast("binary").alias("text")).join(wanted, KEY).select(
        "text", "cuts").mapInArrow(cut, kinds).dropDuplicates(["head", "context"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    """(doc, mark, spans): where windows start that occur elsewhere, as runs (first, last) of starts.

    `docs` is as from `keyed`. Suffixes with equal context are one
    class, counted and never paired. A class of two or more is repeated whole. Otherwise one
    representative of each class is compared with those of the same head, window by window.
    """
    before, least = _before(length)
    rows = stage(suffixes(docs, length), "suffixes")
    family = IndexFamily()
    for batch in range(batches):
        family.add(rows.filter(F.pmod(F.xxhash64(*KEY), F.lit(batches)) == batch))
    # aggregates are stored before joins on their key, so that a hot head can be split there
    repeated = stage(family.repeated(), "all_repeated_heads")
    candidates = stage(rows.join(repeated, "head", "left_semi"), "candidates")
    classes = stage(candidates.groupBy("head", "context").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*KEY, "at", "windows")).alias("one")
    ).select("head", "context", "n", "one.*").select(
        "*", before.alias("before"), least.alias("least")), "classes")
    heads = stage(classes.groupBy("head").agg(F.count(F.lit(1)).alias("classes")).filter(
        "classes > 1"), "shared_heads")
    unlike = classes.join(heads, "head").withColumn("hot", F.col("classes") > GROUP_CLASSES)
    unlike = stage(_contexts(docs, unlike, length), "contexts")
    partial = _compare_groups(unlike.filter("not hot"), length).unionByName(
        _compare_windows(unlike.filter("hot"), length))
    whole = F.array(F.struct(F.lit(0).alias("first"), (F.col("before") - F.col("least")).alias("last")))
    repeated = classes.filter("n > 1").select("head", "context", whole.alias("runs")).unionByName(
        partial.join(classes.filter("n = 1").select("head", "context"), ["head", "context"], "left_semi"))
    start = F.col("at") - before
    return candidates.join(repeated, ["head", "context"]).select(
        *KEY, F.transform("runs", lambda r: F.struct(
            (start + r["first"]).alias("first"), (start + r["last"]).alias("last"))).alias("runs")
    ).groupBy(*KEY).agg(F.flatten(F.collect_set("runs")).alias("spans"))


def without_repeats(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes with their SHA-256 for every row.

    Every byte goes that lies in a string of `length` bytes that also starts anywhere else, in the
    same document or another, first occurrences included. Matches are judged on the input and don't
    cross documents. Null text counts as empty; a text shorter than `length` keeps all. Repeated rows
    are documents of their own and so repeat each other. Extra columns are left out. Rows are told
    apart by their content, so a lost executor or other splits on a rerun change nothing.
    """
    rows = keyed(docs)
    spans = repeated_spans(rows, length, batches)
    rows = rows.withColumn("text", F.col("text").cast("binary")).join(spans, KEY, "left").select(
        "doc_id", "text", F.transform("spans", lambda s: s["first"]).alias("first"),
        F.transform("spans", lambda s: s["last"]).alias("last"))
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, kept, shas = [], [], []
            for row in range(batch.num_rows):
                text = batch.column(1)[row].as_buffer().to_pybytes()
                first, last = batch.column(2)[row].as_py(), batch.column(3)[row].as_py()
                removed, runs = 0, 0
                if first:
                    edge = np.zeros(len(text) + 1, np.int64)
                    np.add.at(edge, np.array(first), 1)
                    np.add.at(edge, np.array(last) + length, -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    removed, runs = int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum())
                    text, size = np.frombuffer(text, np.uint8)[~gone].tobytes(), len(text)
                else:
                    size = len(text)
                counts.append((size, removed, runs))
                kept.append(text)
                shas.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in (0, 1, 2)),
                pa.array(kept, pa.binary()), pa.array(shas, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return rows.mapInArrow(remove, kinds)
