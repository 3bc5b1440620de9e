"""Ranked lexical search in K2-treaps over the term-document grid.

The documents are indexed in blocks. In the grid of a block a row is a term, a column a document, and
a cell the impact of the term in the document. The treap cuts a square in four again and again; every
node takes the largest impact that is left in its square, with its place, so a posting is one node and
no impact below a node is larger than its own. Rows are in descending order of frequency and columns
in ascending order of length, which keeps alike impacts together.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taskspan.llm import text as tx
from taskspan.sources.stage import stage

TOP = 50
BLOCK_POSTINGS = 1 << 21  # of one treap, unless one document has more
BLOCK_DOCS = 1 << 16
BATCH_TERMS = 1 << 20  # terms of the items that are searched together
WIDE = 1 << 16  # ranges times terms of one step of the descent
TERMS = tx.classes("0123456789abcdefghijklmnopqrstuvwxyz", high=1)
_ONES = np.array([bin(k).count("1") for k in range(16)], np.uint8)
INDEX = "doc_ids binary, has_id binary, terms binary, df binary, rows binary, impacts binary, levels array<" \
        "struct<codes binary, places binary, bits binary>>"


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms, A-Z lower-cased, and the first term of each row."""
    low = tx.lowered(data)
    starts, ends, first = tx.tokens(low, offsets, TERMS)
    return tx.Rolling(low).of(starts, ends), first


def _spread(x: np.ndarray) -> np.ndarray:
    """Each bit of a number below 2^32 in every second place."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def _gathered(x: np.ndarray) -> np.ndarray:
    """The bits in every second place as one number."""
    x = x & np.uint64(0x5555555555555555)
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF),
                        (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = (x | (x >> np.uint64(shift))) & np.uint64(mask)
    return x.astype(np.int64)


def _place_type(bits: int) -> type:
    """What holds a place in a square of so many bits a side."""
    return next(t for size, t in ((4, np.uint8), (8, np.uint16), (16, np.uint32), (32, np.uint64))
                if bits <= size)


def _code_type(count: int) -> type:
    return np.uint16 if count <= 1 << 16 else np.uint32


class Level(NamedTuple):
    codes: np.ndarray  # of the impact that a node holds
    places: np.ndarray  # where it is in the node's square, bits of row and column interleaved
    bits: np.ndarray  # which quarters (2 * lower rows + right columns) have a child
    first: np.ndarray  # first child


def grown(rows: np.ndarray, columns: np.ndarray, codes: np.ndarray, side: int
          ) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The levels (codes, places, bits) of the treap of distinct cells in a square of `side` bits."""
    z = (_spread(rows) << np.uint64(1)) | _spread(columns)
    order = np.argsort(z)
    z, codes = z[order], codes[order]
    levels = []
    for bits in range(side, -1, -1):
        if not len(z):
            break
        key = z >> np.uint64(2 * bits)
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        most = np.maximum.reduceat(codes, start)
        node = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(z))))
        at = np.flatnonzero(codes == most[node])
        at = at[np.append(True, node[at][1:] != node[at][:-1])]
        place = z[at] & np.uint64((1 << 2 * bits) - 1)
        rest = np.ones(len(z), bool)
        rest[at] = False
        z, codes, node = z[rest], codes[rest], node[rest]
        quarters = np.zeros(len(start), np.uint8)
        if len(z):
            child = z >> np.uint64(2 * (bits - 1))
            new = np.append(True, child[1:] != child[:-1])
            quarters = np.bincount(
                node[new], weights=1 << (child[new] & np.uint64(3)).astype(np.int64),
                minlength=len(start)).astype(np.uint8)
        levels.append((most, place.astype(_place_type(bits)), quarters))
    return levels


class Block:
    """The treap of a block, ready to be searched."""

    def __init__(self, row: dict):
        self.doc_ids = np.frombuffer(row["doc_ids"], np.int64)
        self.has_id = np.frombuffer(row["has_id"], bool)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.rows = np.frombuffer(row["rows"], np.uint32)
        self.impacts = np.frombuffer(row["impacts"], np.int64)
        self.side = side_of(len(self.terms), len(self.doc_ids))
        code = _code_type(len(self.impacts))
        self.levels = []
        for k, level in enumerate(row["levels"]):
            bits = np.frombuffer(level["bits"], np.uint8)
            self.levels.append(Level(
                np.frombuffer(level["codes"], code),
                np.frombuffer(level["places"], _place_type(self.side - k)), bits,
                np.append(0, np.cumsum(_ONES[bits], dtype=np.int64))[:-1]))

    def found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms the block has, and their rows."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        have = np.flatnonzero(self.terms[at] == hashes)
        return have, self.rows[at[have]].astype(np.int64)


def side_of(terms: int, docs: int) -> int:
    return (max(terms, docs, 1) - 1).bit_length()


class Best:
    """The best documents of one item so far: (score, has no id, doc_id)."""

    def __init__(self, top: int):
        self.top, self.least = top, 1
        self.held = np.zeros((0, 3), np.int64)

    def add(self, scores: np.ndarray, has_id: np.ndarray, doc_ids: np.ndarray) -> None:
        good = scores >= self.least
        if not good.any():
            return
        more = np.stack([scores[good], ~has_id[good], doc_ids[good]], axis=1)
        self.held = np.concatenate([self.held, more])
        order = np.lexsort((self.held[:, 2], self.held[:, 1], -self.held[:, 0]))[:self.top]
        self.held = self.held[order]
        if len(self.held) == self.top:
            self.least = max(1, int(self.held[-1, 0]))


class _Front(NamedTuple):
    """Document ranges of one size: their numbers in ascending order; (range, term, node) of the paths
    that go on, by place in `ranges`; and (document, term, impact) found in them so far."""

    bits: int
    ranges: np.ndarray
    at: np.ndarray
    term: np.ndarray
    node: np.ndarray
    seen: tuple[np.ndarray, np.ndarray, np.ndarray]


def search(block: Block, rows: np.ndarray, weights: np.ndarray, best: Best, wide: int = WIDE) -> None:
    """Add the documents of the block to the best of an item with terms in these rows.

    The paths of all rows descend together. A document range scores at most the sum, over the terms,
    of the weight times the larger of the node's impact and of what has been found in the range. The
    ranges of the highest bound go first, many at a time, and those below the least score that still
    counts are left out. A range that no path leads into is decided by what has been found in it.
    """
    q = len(rows)
    if not q or not block.levels:
        return
    none = np.zeros(0, np.int64)
    start = _Front(block.side, np.zeros(1, np.int64), np.zeros(q, np.int64), np.arange(q),
                   np.zeros(q, np.int64), (none, none, none))
    heap = [(-(1 << 62), 0, start)]
    number = 0
    while heap and -heap[0][0] >= best.least:
        front = heapq.heappop(heap)[2]
        s = front.bits
        level = block.levels[block.side - s]
        own = level.places[front.node].astype(np.uint64)
        hit = np.flatnonzero(_gathered(own >> np.uint64(1)) == (rows[front.term] & ((1 << s) - 1)))
        docs = (front.ranges[front.at[hit]] << s) | _gathered(own[hit])
        seen = tuple(np.concatenate(x) for x in zip(front.seen, (
            docs, front.term[hit], block.impacts[level.codes[front.node[hit]]])))
        ranges, at, term, node = none, none, none, none
        if s:
            bits = level.bits[front.node].astype(np.int64)
            lower = 2 * ((rows[front.term] >> (s - 1)) & 1)
            both = []
            for right in (0, 1):
                quarter = lower + right
                go = np.flatnonzero((bits >> quarter) & 1)
                child = level.first[front.node[go]] + _ONES[bits[go] & ((1 << quarter[go]) - 1)]
                both.append((2 * front.ranges[front.at[go]] + right, front.term[go], child))
            of, term, node = (np.concatenate(x) for x in zip(*both))
            ranges, at = np.unique(of, return_inverse=True)
        inside = seen[0] >> max(s - 1, 0)
        place = np.searchsorted(ranges, inside)
        live = np.zeros(len(inside), bool)
        some = place < len(ranges)
        live[some] = ranges[place[some]] == inside[some]
        if not live.all():  # nothing more is to be found in these documents
            found, number_of = np.unique(seen[0][~live], return_inverse=True)
            scores = np.zeros(len(found), np.int64)
            np.add.at(scores, number_of, weights[seen[1][~live]] * seen[2][~live])
            best.add(scores, block.has_id[found], block.doc_ids[found])
        if not len(ranges):
            continue
        seen, place = tuple(x[live] for x in seen), place[live]
        impact = block.impacts[block.levels[block.side - s + 1].codes[node]]
        most = np.zeros((len(ranges), q), np.int64)
        mine = np.argsort(seen[2], kind="stable")  # of equal cells the last one stays
        most[place[mine], seen[1][mine]] = seen[2][mine]
        most[at, term] = np.maximum(most[at, term], impact)
        bound = most @ weights
        keep = bound >= best.least
        parts = [keep]
        if keep.sum() * q > wide:  # the ranges with the higher bounds go on apart from the others
            cut = np.median(bound[keep])
            parts = [keep & (bound > cut), keep & (bound <= cut)]
        for part in parts:
            if not part.any():
                continue
            new = np.cumsum(part) - 1
            on, with_seen = part[at], part[place]
            number += 1
            heapq.heappush(heap, (-int(bound[part].max()), number, _Front(
                s - 1, ranges[part], new[at[on]], term[on], node[on], tuple(x[with_seen] for x in seen))))


def _counted(docs: DataFrame) -> tuple[int, int]:
    """The number of documents with a term, and of all their terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.flat(batch.column(0))
            some = terms = 0
            for low, high in tx.slices(offsets):
                at = offsets[low:high + 1] - offsets[low]
                _, _, first = tx.tokens(tx.lowered(data[offsets[low]:offsets[high]]), at, TERMS)
                some, terms = some + int((np.diff(first) > 0).sum()), terms + int(first[-1])
            yield pa.RecordBatch.from_arrays([pa.array([some]), pa.array([terms])], ["docs", "terms"])

    row = docs.select("text").mapInArrow(count, "docs long, terms long").agg(
        F.sum("docs"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def _treap(doc_ids: list, lengths: np.ndarray, hashes: np.ndarray, docs: np.ndarray, tf: np.ndarray,
           n_docs: int, n_terms: int) -> pa.RecordBatch:
    """The index row of a block of postings (hash, document, tf)."""
    order = np.argsort(lengths, kind="stable")
    column = np.empty(len(order), np.int64)
    column[order] = np.arange(len(order))
    terms, row = np.unique(hashes, return_inverse=True)
    df = np.bincount(row, minlength=len(terms))
    rows = np.empty(len(terms), np.uint32)
    rows[np.argsort(-df, kind="stable")] = np.arange(len(terms))
    length, of = np.unique(lengths, return_inverse=True)
    m = np.array([50 + 50 * n * n_docs // n_terms for n in length.tolist()], np.int64)[of][docs]
    impact = (1_000_000_000 * tf) // (1_000 * tf + 20 * m)
    impacts, codes = np.unique(impact, return_inverse=True)
    levels = grown(rows[row], column[docs], codes, side_of(len(terms), len(doc_ids)))
    code = _code_type(len(impacts))
    ids = [doc_ids[k] for k in order.tolist()]
    held = {
        "doc_ids": np.array([d or 0 for d in ids], np.int64), "has_id": np.array([d is not None for d in ids]),
        "terms": terms, "df": df.astype(np.uint32), "rows": rows, "impacts": impacts.astype(np.int64)}
    return pa.RecordBatch.from_pylist([
        {n: x.tobytes() for n, x in held.items()} | {"levels": [
            {"codes": c.astype(code).tobytes(), "places": p.tobytes(), "bits": b.tobytes()}
            for c, p, b in levels]}], pa.schema(
        [(n, pa.binary()) for n in held] + [("levels", pa.list_(pa.struct(
            [("codes", pa.binary()), ("places", pa.binary()), ("bits", pa.binary())])))]))


def index(docs: DataFrame, block_postings: int = BLOCK_POSTINGS, block_docs: int = BLOCK_DOCS
          ) -> tuple[DataFrame, int]:
    """The stored treaps of all rows of `docs` (doc_id, text), and the number of rows with a term."""
    n_docs, n_terms = _counted(docs)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        lengths: list[np.ndarray] = []
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def made() -> pa.RecordBatch:
            return _treap(ids, np.concatenate(lengths), *(np.concatenate(x) for x in zip(*parts)),
                          n_docs, n_terms)

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            data, offsets = tx.flat(batch.column(1))
            for low, high in tx.slices(offsets):
                at = offsets[low:high + 1] - offsets[low]
                hashes, first = term_hashes(data[offsets[low]:offsets[high]], at)
                count = np.diff(first)
                some = np.flatnonzero(count)
                if not len(some):
                    continue
                doc = np.repeat(np.arange(len(some)), count[some])
                order = np.lexsort((hashes, doc))
                hashes, doc = hashes[order], doc[order]
                new = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])))
                parts.append((hashes[new], doc[new] + len(ids), np.diff(np.append(new, len(doc)))))
                lengths.append(count[some])
                ids += [doc_ids[low + k] for k in some.tolist()]
                size += len(new)
                if size >= block_postings or len(ids) >= block_docs:
                    yield made()
                    ids, lengths, parts, size = [], [], [], 0
        if ids:
            yield made()

    return stage(docs.select("doc_id", "text").mapInArrow(build, INDEX), "treaps"), n_docs


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, terms, n): the distinct terms of every row with terms, numbered and stored."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.flat(batch.column(2))
            hashes, first = term_hashes(data, offsets)
            terms = [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(terms, pa.list_(pa.int64())),
                 pa.array(np.array([len(t) for t in terms], np.int64))], ["item", "item_id", "terms", "n"])

    numbered = benchmark.select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    return stage(numbered.mapInArrow(read, "item long, item_id long, terms array<long>, n long").filter(
        "n > 0"), "items")


def _weights(treaps: DataFrame, terms: np.ndarray, n_docs: int) -> np.ndarray:
    """The weight of each of these sorted terms, by the number of documents that hold it."""
    shared = treaps.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for have, df in zip(batch.column(0), batch.column(1)):
                own = np.frombuffer(have.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(own, shared.value), len(own) - 1)
                same = own[at] == shared.value
                held[same] += np.frombuffer(df.as_buffer(), np.uint32)[at[same]]
        term = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(held[term])], ["term", "df"])

    df = np.zeros(len(terms), np.int64)
    for row in treaps.select("terms", "df").mapInArrow(count, "term long, df long").groupBy("term").agg(
            F.sum("df").alias("df")).collect():  # at most one row per term of the batch
        df[row["term"]] = row["df"]
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def _searched(treaps: DataFrame, items: DataFrame, n_docs: int, top: int) -> DataFrame:
    """(item, no_id, doc_id, score): the best of each task for every item of a bounded batch."""
    rows = items.select("item", "terms").collect()
    lists = [np.array(r["terms"], np.int64).view(np.uint64) for r in rows]
    terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *lists]))
    weight = _weights(treaps, terms, n_docs)
    asked = []
    for r, own in zip(rows, lists):
        w = weight[np.searchsorted(terms, own)]
        asked.append((r["item"], own[w > 0], w[w > 0]))
    shared = treaps.sparkSession.sparkContext.broadcast(asked)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in shared.value]
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                for (_, hashes, weights), mine in zip(shared.value, best):
                    have, at = block.found(hashes)
                    search(block, at, weights[have], mine)
        item = np.repeat(np.array([a[0] for a in shared.value], np.int64), [len(b.held) for b in best])
        held = np.concatenate([np.zeros((0, 3), np.int64), *(b.held for b in best)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array(held[:, 1] == 1), pa.array(held[:, 2], mask=held[:, 1] == 1),
             pa.array(held[:, 0])], ["item", "no_id", "doc_id", "score"])

    # one row is one block of some megabytes
    return treaps.drop("df").mapInArrow(find, "item long, no_id boolean, doc_id long, score long")


def ranked_documents(docs: DataFrame, benchmark: DataFrame, top: int = TOP, batch_terms: int = BATCH_TERMS,
                     **blocks) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of every row of `benchmark` by score.

    Terms are maximal runs of letters and digits (any non-ASCII character counts as a letter), A-Z
    lower-cased, and are compared by 64-bit hash. Every row of `docs` with a term is a document, so
    repeated rows rank each, and every row of `benchmark` is an item. Equal scores are in ascending
    order of doc_id (null last). Null or empty texts have no terms: such documents are not found and
    such items find nothing. Extra columns are left out.

    Items are searched in batches of some `batch_terms` terms, the only thing that is broadcast; a
    task keeps `top` documents per item, which bound what it looks at in its further blocks.
    """
    treaps, n_docs = index(docs, **blocks)
    items = _items(benchmark)
    batches = 1 + (items.agg(F.sum("n")).first()[0] or 0) // batch_terms
    batch = F.pmod(F.xxhash64("item"), F.lit(batches))
    found = None
    for k in range(batches):
        part = stage(_searched(treaps, items.filter(batch == k), n_docs, top), "hits")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "no_id", "doc_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
