"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskspan.llm import text as tx
from taskspan.llm.columns import apart
from taskspan.sources.stage import stage

WINDOW = 10
BLOCK_WORDS = 200_000  # item words of one automaton: at most twice as many states
MOST_COVERAGE = 0.5
LETTERS = tx.classes("0123456789abcdefghijklmnopqrstuvwxyz", high=1)
Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
SPANS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()),
                                  T.StructField("last", T.IntegerType())]))


def words_of(data: np.ndarray, offsets: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the normalised words, and the first word of each row."""
    low = tx.lowered(data)
    starts, ends, first = tx.tokens(low, offsets, LETTERS)
    return tx.Rolling(low).of(starts, ends), starts, ends, first


class Automaton:
    """A generalised suffix automaton over the words of (item_id, word hashes) items.

    A state stands for the word sequences that end at the same places of the items; `longest` is the
    length of the longest one, `link` the state of the longest suffix that ends at more places.
    """

    def __init__(self, items: list[tuple[int, np.ndarray]], window: int = WINDOW):
        self.window = window
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *(w for _, w in items)]))
        self.step: list[dict[int, int]] = [{}]
        self.longest, self.link = [0], [-1]
        coded = [(item, np.searchsorted(self.vocabulary, words)) for item, words in items if len(words)]
        self.shortest = min([window, *(len(words) for _, words in coded)])
        pairs = [words[:-1] * len(self.vocabulary) + words[1:] for _, words in coded]
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]))
        paths = []
        for item, words in coded:
            state, path = 0, []
            for word in words.tolist():
                state = self._extended(state, word)
                path.append(state)
            paths.append((item, path))
        self.items: dict[int, list[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for item, path in paths:
            self._claim(item, path)
        self.above: dict[int, list[tuple[int, int]]] = {}

    def _new(self, longest: int, link: int, step: dict[int, int]) -> int:
        self.longest.append(longest)
        self.link.append(link)
        self.step.append(step)
        return len(self.step) - 1

    def _extended(self, last: int, word: int) -> int:
        """The state of `last`'s longest sequence with `word` behind it, made if need be."""
        known = self.step[last].get(word)
        if known is not None:
            return known if self.longest[known] == self.longest[last] + 1 else self._split(
                last, word, known)
        state = self._new(self.longest[last] + 1, 0, {})
        at = last
        while at >= 0 and word not in self.step[at]:
            self.step[at][word] = state
            at = self.link[at]
        if at >= 0:
            known = self.step[at][word]
            self.link[state] = (known if self.longest[known] == self.longest[at] + 1
                                else self._split(at, word, known))
        return state

    def _split(self, at: int, word: int, known: int) -> int:
        """The part of `known` that is no longer than `at` and `word` becomes a state of its own."""
        copy = self._new(self.longest[at] + 1, self.link[known], dict(self.step[known]))
        self.link[known] = copy
        while at >= 0 and self.step[at].get(word) == known:
            self.step[at][word] = copy
            at = self.link[at]
        return copy

    def _claim(self, item: int, path: list[int]) -> None:
        """Note the item at the states of its windows."""
        size = min(self.window, len(path))
        for end in range(size, len(path) + 1):
            state = path[end - 1]
            while self.longest[self.link[state]] >= size:
                state = self.link[state]
            if len(path) < self.window:
                self.short.setdefault(state, []).append((size, item))
            elif item not in (known := self.items.setdefault(state, [])):
                known.append(item)

    def _shorts(self, state: int) -> list[tuple[int, int]]:
        """(length, item) of the short items that end where the state's sequences end."""
        found = self.above.get(state)
        if found is None:
            own = self.short.get(state, [])
            found = self.above[state] = own + (self._shorts(self.link[state]) if state > 0 else [])
        return found

    def windows(self, words: list[int]) -> Iterator[tuple[int, int, list[int]]]:
        """(first, last, items) of every window that occurs in a run of known words."""
        state, length = 0, 0
        for at, word in enumerate(words):
            while state and word not in self.step[state]:
                state = self.link[state]
                length = self.longest[state]
            if word in self.step[state]:
                state = self.step[state][word]
                length += 1
            if length >= self.window:
                full = state
                while self.longest[self.link[full]] >= self.window:
                    full = self.link[full]
                yield at + 1 - self.window, at + 1, self.items.get(full, [])
            for size, item in self._shorts(state) if self.short else ():
                if size <= length:
                    yield at + 1 - size, at + 1, [item]

    def runs(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Where a window can lie: (first word, coded words) of runs of words known side by side.

        A match of two or more words has only known pairs, so the longest match at the start of a
        run is that one word, and the automaton may start there from its root.
        """
        if not len(hashes) or not len(self.vocabulary):
            return
        code = np.searchsorted(self.vocabulary, hashes)
        code[code == len(self.vocabulary)] = 0
        known = self.vocabulary[code] == hashes
        joined = np.zeros(len(hashes) + 1, bool)  # with the word before
        both = np.flatnonzero(known[1:] & known[:-1])
        pair = code[both] * len(self.vocabulary) + code[both + 1]
        if len(self.pairs):
            place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[both[self.pairs[place] == pair] + 1] = True
        joined[first] = False
        starts = np.flatnonzero(~joined[:-1])
        ends = np.append(starts[1:], len(hashes))
        good = (ends - starts >= self.shortest) & known[starts]
        for start, end in zip(starts[good].tolist(), ends[good].tolist()):
            yield start, code[start:end].tolist()


def _automata(benchmark: DataFrame, window: int, block_words: int) -> Iterator[tuple[Automaton, bool]]:
    """One automaton per block of items, and whether it is the last one; an item is whole in its block,
    repeated rows count once."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").distinct().toLocalIterator():
        data = np.frombuffer((row["text"] or "").encode(), np.uint8)
        words = words_of(data, np.array([0, len(data)]))[0]
        if block and size + len(words) > block_words:
            yield Automaton(block, window), False
            block, size = [], 0
        block.append((row["item_id"], words))
        size += len(words)
    yield Automaton(block, window), True


def _marked(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """The union of the spans as disjoint runs."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [{"first": s, "last": e} for s, e in out]


def _scan(docs: DataFrame, text: int, automaton, again: bool, then: Step | None) -> DataFrame:
    """Append (or widen, if `again`) the columns n_words, spans and items at the end of `docs`; with
    `then` its rows instead, which have the columns of `docs` without the three."""
    own = T.StructType(docs.schema.fields[:-3 if again else None])
    kinds = T.StructType([*own.fields,
                          T.StructField("n_words", T.LongType()),
                          T.StructField("spans", SPANS),
                          T.StructField("items", T.ArrayType(T.LongType()))])
    kept = len(own)
    match = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = automaton.value
        for batch in tx.pieces(batches, text):
            data, offsets = tx.flat(batch.column(text))
            n_words = np.zeros(batch.num_rows, np.int64)
            found: dict[int, tuple[list, set]] = {}
            for low, high in tx.slices(offsets):
                at = offsets[low:high + 1] - offsets[low]
                hashes, _, _, first = words_of(data[offsets[low]:offsets[high]], at)
                n_words[low:high] = np.diff(first)
                for start, words in search.runs(hashes, first):
                    row = int(np.searchsorted(first, start, "right")) - 1
                    shift = start - int(first[row])
                    for begin, end, items in search.windows(words):
                        spans, ids = found.setdefault(low + row, ([], set()))
                        spans.append((shift + begin, shift + end))
                        ids.update(items)
            spans, items = [[]] * batch.num_rows, [[]] * batch.num_rows
            if again:
                spans = [[*x] for x in batch.column(kept + 1).to_pylist()]
                items = [[*x] for x in batch.column(kept + 2).to_pylist()]
            for row, (more, ids) in found.items():
                old = [(x["first"], x["last"]) for x in spans[row]]
                spans[row] = _marked(old + more)
                items[row] = sorted({*items[row], *ids}, key=lambda x: (x is None, x))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:kept], pa.array(n_words), pa.array(spans, match),
                 pa.array(items, pa.list_(pa.int64()))],
                names=[*batch.schema.names[:kept], "n_words", "spans", "items"])

    if then is None:
        return docs.mapInArrow(scan, kinds)
    return docs.mapInArrow(lambda batches: then(scan(batches)), own)


def matched(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
            block_words: int = BLOCK_WORDS, then: Step | None = None) -> DataFrame:
    """The rows and columns of `docs`, then n_words, spans (of word numbers, disjoint) and items.

    A window is `window` consecutive words of an item, or all of a shorter item's words; the spans
    are the union of all places where a window occurs. Words are maximal runs of letters and digits
    (any non-ASCII character counts as a letter), A-Z lower-cased, and are compared by 64-bit hash.

    The items are taken in blocks of `block_words`, as only a bounded automaton is broadcast; with
    more than one block the documents are scanned once per block and stored in between. `then` turns
    the batches of the result into ones with the columns of `docs`, in the Python worker of the last
    scan; a step of its own would keep a second worker and the batches of both in memory.

    Null or empty texts have no words; items without words match nothing; an item_id on several rows
    stands for all their texts; null item_ids match but appear as null in `items`.
    """
    text, again = docs.columns.index("text"), False
    for automaton, last in _automata(benchmark, window, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(automaton)
        docs = _scan(stage(docs, "scanned") if again else docs, text, shared, again, then if last else None)
        again = True
    return docs


def report(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """doc_id, n_words, n_hit, item ids and hit spans for every row of `docs`."""
    found = matched(docs.select("doc_id", "text"), benchmark, **settings)
    lengths = F.transform("spans", lambda s: (s["last"] - s["first"]).cast("long"))
    n_hit = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, b: a + b)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", "spans")


def decontaminated(docs: DataFrame, benchmark: DataFrame, most_coverage: float = MOST_COVERAGE,
                   **settings) -> DataFrame:
    """`docs` without the hit spans, and without rows of which more than `most_coverage` is hit.

    A span is cut from its first word to the start of the word behind it. n_chars, if there is such
    a column, becomes the new length; rows without hits stay as they are.
    """
    n, text, counted = len(docs.columns), docs.columns.index("text"), "n_chars" in docs.columns
    length = docs.columns.index("n_chars") if counted else -1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, n_words = batch.column(n + 1), batch.column(n)
            hit = [row for row, s in enumerate(spans.to_pylist()) if s]
            columns = list(batch.columns[:n])
            keep = np.ones(batch.num_rows, bool)
            changed: dict[int, str] = {}
            for row in hit:
                source = columns[text][row].as_py().encode()
                data = np.frombuffer(source, np.uint8)
                _, starts, _, _ = words_of(data, np.array([0, len(data)]))
                begin = np.append(starts, len(data))
                runs = [(s["first"], s["last"]) for s in spans[row].as_py()]
                if sum(e - s for s, e in runs) > most_coverage * n_words[row].as_py():
                    keep[row] = False
                    continue
                pieces, at = [], 0
                for s, e in runs:
                    pieces.append(source[at:begin[s]])
                    at = begin[e]
                changed[row] = b"".join([*pieces, source[at:]]).decode("utf-8", "replace")
            if changed:
                at = np.zeros(batch.num_rows, bool)
                at[list(changed)] = True
                values = [changed[row] for row in sorted(changed)]
                columns[text] = pc.replace_with_mask(
                    columns[text], pa.array(at), pa.array(values, columns[text].type))
                if counted:
                    columns[length] = pc.replace_with_mask(columns[length], pa.array(at), pa.array(
                        [len(value) for value in values], columns[length].type))
            out = pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:n])
            yield out.filter(pa.array(keep))

    return matched(apart(docs, "text"), benchmark, then=cut, **settings).toDF(*docs.columns)
