"""A trie of conversation prefixes: count-min screening of prefix digests, exact groups of the rest.

A prefix is known by two 64-bit digests: the exclusive-or of hashes of its turns, each hashed with its
place, so that the digests of all prefixes are running values that can be taken up in the middle of a
conversation. Texts are read once, for their hashes and sizes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskspan.llm.ordering import parts_of
from taskspan.sources.stage import stage

FAMILY = 5  # conversations that start with the turns of the smallest one of them
HEADS = 9  # 0 to 8 turns of it
MOST_CELLS = 1 << 24  # of one row of the sketch, a byte each
SKETCH_ROWS = 2
CHUNK = 1 << 16
SHARE = 1_000  # a key with more than one in so many rows is joined by broadcast: fewer than SHARE keys
EMPTY = hashlib.sha256(b"").hexdigest()
_NODE = ["dx", "dy"]


def _segments(keys: np.ndarray) -> np.ndarray:
    """For each row the first row of its run of equal keys."""
    start = np.append(True, keys[1:] != keys[:-1])
    return np.maximum.accumulate(np.where(start, np.arange(len(keys)), 0))


def running(rows: DataFrame, by: str, order: Sequence[Column], sums: Sequence[str] = (),
            xors: Sequence[str] = (), keep: Sequence[str] = (), name: str = "running") -> DataFrame:
    """`by`, `keep` and, under their own names, running values (own row included) of the columns.

    Rows are dealt into ranges of (by, order), so that a key of many rows is cut, and each task adds
    up its range. Only a key that reaches into a range from an earlier one has a carry, so there are
    fewer carries than ranges. `rows` must be stored (they are read twice) and `by` a long, not null.
    """
    values = [*sums, *xors]
    at = F.monotonically_increasing_id()  # tells equal rows apart where a range is cut, no more
    dealt = rows.withColumn("_row", at).repartitionByRange(
        parts_of(rows.sparkSession), by, *order, "_row").sortWithinPartitions(by, *order).select(
        by, *keep, *values)
    types = {f.name: f.dataType.simpleString() for f in dealt.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in dealt.columns)
    schema += "".join(f", run_{c} long" for c in values) + ", range int, lead boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, lead, last, state = TaskContext.get().partitionId(), None, None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            begin = _segments(keys)
            lead = keys[0] if lead is None else lead
            found = []
            for c in values:
                value = batch.column(batch.schema.get_field_index(c)).to_numpy()
                if c in sums:
                    added = np.cumsum(value)
                    out = added - added[begin] + value[begin]
                else:
                    added = np.bitwise_xor.accumulate(value)
                    out = added ^ added[begin] ^ value[begin]
                if keys[0] == last:
                    out[begin == 0] = out[begin == 0] + state[c] if c in sums else out[begin == 0] ^ state[c]
                state[c] = out[-1]
                found.append(pa.array(out))
            last = keys[-1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *found, pa.array(np.full(len(keys), part, np.int32)), pa.array(keys == lead)],
                [*batch.schema.names, *(f"run_{c}" for c in values), "range", "lead"])

    placed = stage(dealt.mapInArrow(run, schema), name)
    leads = placed.filter("lead").select("range", by).distinct()
    totals = placed.join(F.broadcast(leads.select(by).distinct()), by).groupBy("range", by).agg(
        *(F.sum(c).alias(c) for c in sums), *(F.bit_xor(c).alias(c) for c in xors))
    before = Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        "range", by, *(F.sum(c).over(before).alias(f"from_{c}") for c in sums),
        *(F.bit_xor(c).over(before).alias(f"from_{c}") for c in xors)).join(leads, ["range", by])
    joined = placed.join(F.broadcast(stage(carry, f"{name}_carry")), ["range", by], "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        by, *keep,
        *((F.col(f"run_{c}") + F.coalesce(f"from_{c}", zero)).alias(c) for c in sums),
        *(F.col(f"run_{c}").bitwiseXOR(F.coalesce(f"from_{c}", zero)).alias(c) for c in xors),
        *(F.col(c).alias(f"own_{c}") for c in xors))


def by_key(rows: DataFrame, side: DataFrame, key: Sequence[str], rows_of_key: Column, total: int,
           how: str = "inner") -> DataFrame:
    """`rows` joined with `side`, one row per key, of which `rows_of_key` is at least the number of
    its rows among `total` ones: keys of many rows meet a broadcast, the others are dealt by key."""
    key = list(key)
    heavy = rows_of_key * SHARE > total
    few = stage(side.filter(heavy), "heavy_keys")
    often = rows.join(F.broadcast(few), key)
    rest = rows.join(F.broadcast(few.select(*key)), key, "left_anti").join(side.filter(~heavy), key, how)
    return often.unionByName(rest)


def _rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length) of every conversation, and the stored turns (conv_id, depth, a, b, bytes,
    length) of the rebuilt ones: the first turns of the family, then the own ones after as many."""
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.lit(1).cast("long").alias("place")).withColumns({
            "a": F.xxhash64(F.lit(1), "role", "text"), "b": F.xxhash64(F.lit(2), "role", "text"),
            "bytes": F.octet_length("text").cast("long")})
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = stage(running(turns, "conv_id", order, sums=["place"], keep=["a", "b", "bytes"], name="turns"),
                   "placed").withColumn("place", F.col("place") - 1)
    convs = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumns({
        "base": F.col("conv_id") - F.col("conv_id") % FAMILY,
        "h": F.crc32(F.col("conv_id").cast("string")) % HEADS})
    convs = stage(convs, "conversations")
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = stage(convs.join(bases, "base", "left").withColumn(
        "taken", F.least("h", F.coalesce("base_n", F.lit(0)))).withColumn(
        "length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).drop("base_n"), "lengths")

    first = placed.filter(F.col("place") < HEADS - 1).withColumnRenamed("conv_id", "base").join(
        convs.select("conv_id", "base", "taken", "length"), "base").filter("place < taken").select(
        "conv_id", (F.col("place") + 1).alias("depth"), "a", "b", "bytes", "length")
    total = convs.agg(F.sum("n")).first()[0] or 0
    own = by_key(placed, convs, ["conv_id"], F.col("n"), total).filter("place >= h").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("taken") + 1).alias("depth"), "a", "b", "bytes",
        "length")
    return convs.select("conv_id", "length"), stage(first.unionByName(own), "rebuilt")


def _cells(dx: np.ndarray, dy: np.ndarray, width: int) -> list[np.ndarray]:
    """The cell of each digest in every row of the sketch."""
    shift = np.uint64(64 - (width - 1).bit_length())
    x, y = dx.view(np.uint64), dy.view(np.uint64)
    return [((x * np.uint64(2 * k + 1) + y * np.uint64(k)) >> shift).astype(np.int64)
            for k in range(SKETCH_ROWS)]


def _sketch(prefixes: DataFrame, width: int) -> np.ndarray:
    """The count-min sketch (SKETCH_ROWS, width) of the prefix digests; counts stop at two."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((SKETCH_ROWS, width), np.uint8)
        for batch in batches:
            for row, cells in zip(counts, _cells(*(c.to_numpy() for c in batch.columns), width)):
                cell, n = np.unique(cells, return_counts=True)
                row[cell] = np.minimum(row[cell] + n, 2)
        for k, chunk in enumerate(counts.reshape(-1, min(width, CHUNK))):
            if chunk.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([chunk.tobytes()])], ["chunk", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            for k, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                more = np.frombuffer(cells, np.uint8)
                if k != now and now is not None:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([now], pa.int32()), pa.array([held.tobytes()])], ["chunk", "cells"])
                held = more if k != now else np.minimum(held + more, 2)
                now = k
        if now is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([held.tobytes()])], ["chunk", "cells"])

    schema = "chunk int, cells binary"
    parts = prefixes.select(*_NODE).mapInArrow(count, schema)
    merged = parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(merge, schema)
    whole = np.zeros((SKETCH_ROWS * width) // min(width, CHUNK) * min(width, CHUNK), np.uint8)
    for k, cells in merged.collect():  # SKETCH_ROWS * MOST_CELLS bytes at most
        at = k * min(width, CHUNK)
        whole[at:at + len(cells)] = np.frombuffer(cells, np.uint8)
    return whole.reshape(SKETCH_ROWS, width)


def _screened(prefixes: DataFrame, total: int, most_cells: int) -> DataFrame:
    """`prefixes` with `own` and `up`: whether the prefix, and the one before it, may be shared."""
    width = min(most_cells, 1 << max(10, (4 * total).bit_length()))
    sketch = prefixes.sparkSession.sparkContext.broadcast(_sketch(prefixes, width))
    schema = ", ".join(f"{n} {t}" for n, t in prefixes.dtypes) + ", own boolean, up boolean"
    at = {c: prefixes.columns.index(c) for c in ("dx", "dy", "px", "py", "depth")}

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch in batches:
            column = {c: batch.column(k).to_numpy() for c, k in at.items()}

            def several(x: str, y: str) -> np.ndarray:
                least = [row[cells] for row, cells in zip(counts, _cells(column[x], column[y], width))]
                return np.minimum.reduce(least) > 1

            own, up = several("dx", "dy"), several("px", "py") | (column["depth"] == 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own), pa.array(up)], [*batch.schema.names, "own", "up"])

    return stage(prefixes.mapInArrow(screen, schema), "screened")


def _digests_of_ends(ends: DataFrame) -> DataFrame:
    """(dx, dy, ends_sha256) of the conv_ids of every node, ascending, comma-joined.

    The ids of a node are joined to text in ranges of their order, many ids to a row, and a task
    hashes these rows one after the other, so it never holds the ids of a node.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            dx, dy, ids = (c.to_numpy() for c in batch.columns)
            change = np.flatnonzero((dx[1:] != dx[:-1]) | (dy[1:] != dy[:-1])) + 1
            starts, stops = np.append(0, change), np.append(change, len(ids))
            texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(starts, stops)]
            numbers = np.arange(number, number + len(starts))
            number += len(starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(dx[starts]), pa.array(dy[starts]), pa.array(np.full(len(starts), part, np.int64)),
                 pa.array(numbers), pa.array(texts, pa.string())], ["dx", "dy", "range", "number", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]]), pa.array([now[1]]), pa.array([state.hexdigest()])],
                ["dx", "dy", "ends_sha256"])

        for batch in batches:
            for dx, dy, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 4))):
                if (dx, dy) == now:
                    state.update(b"," + ids.encode())
                    continue
                if now:
                    yield row()
                now, state = (dx, dy), hashlib.sha256(ids.encode())
        if now:
            yield row()

    parts = parts_of(ends.sparkSession)
    order = ["dx", "dy", "conv_id"]
    texts = ends.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(
        join, "dx long, dy long, range long, number long, ids string")
    return texts.repartition(*_NODE).sortWithinPartitions(*_NODE, "range", "number").mapInArrow(
        hashed, "dx long, dy long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """One row per distinct sequence of first turns of the rebuilt conversations (see `_rebuilt`).

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256 (hash of the members that end there), as stated in README.

    A prefix that the sketch counts once belongs to one conversation: its row is made where it is,
    and only if the prefix before it may be shared it looks for that one. All other prefixes are
    grouped. Sums over subtrees need no walk: the nodes whose smallest member is one conversation
    are a path, summed up from its end, and the sum of the path goes to the shorter prefixes of
    that conversation, which it knows.

    Turns are ordered by turn (null first), then role and text, so repeated rows count each; null
    roles and texts are empty. Rows without conv_id are no conversation. A conversation without turns
    ends in the root. An empty table has no nodes. Extra columns are left out.
    """
    convs, rebuilt = _rebuilt(conversations)
    hashed = rebuilt.select(
        "conv_id", "depth", "bytes", "length", F.xxhash64(F.lit(3), "depth", "a", "b").alias("dx"),
        F.xxhash64(F.lit(4), "depth", "a", "b").alias("dy"))
    prefixes = running(hashed, "conv_id", [F.col("depth")], xors=["dx", "dy"],
                       keep=["depth", "bytes", "length"], name="prefixes")
    prefixes = prefixes.withColumns({
        "px": F.col("dx").bitwiseXOR(F.col("own_dx")), "py": F.col("dy").bitwiseXOR(F.col("own_dy"))}).drop("own_dx", "own_dy")
    total = convs.agg(F.sum("length")).first()[0] or 0
    screened = _screened(prefixes, total, most_cells)
    maybe = screened.filter("own")
    nodes = stage(maybe.groupBy(*_NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("depth").alias("depth"),
        F.max("bytes").alias("bytes"), F.min("px").alias("px"), F.min("py").alias("py"),
        F.max("length").alias("length")), "nodes")
    none = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter(
        "n_convs > 0").select(
        none.alias("dx"), none.alias("dy"), "conv_id", "n_convs", none.alias("depth"), none.alias("bytes"),
        F.lit(None).cast("long").alias("px"), F.lit(None).cast("long").alias("py"), none.alias("length"))
    shared = stage(nodes.filter("n_convs > 1").unionByName(root), "shared")

    parents = shared.select(
        F.col("dx").alias("px"), F.col("dy").alias("py"), F.col("conv_id").alias("parent_conv_id"),
        F.col("n_convs").alias("above"))
    columns = ["conv_id", "depth", "length", "px", "py", "up"]
    alone = screened.filter("not own").select(*columns).unionByName(
        nodes.filter("n_convs = 1").withColumn("up", F.lit(True)).select(*columns))
    bottom = alone.filter("not up").select(
        "conv_id", "depth", "length", F.col("conv_id").alias("parent_conv_id"))
    edge = stage(by_key(alone.filter("up").drop("up"), parents, ["px", "py"], F.col("above"), total, "left"),
                 "edge")
    singles = bottom.unionByName(edge.select(
        "conv_id", "depth", "length", F.coalesce("parent_conv_id", "conv_id").alias("parent_conv_id")))

    below = edge.filter("parent_conv_id is not null").select("px", "py", F.lit(1).alias("lone")).unionByName(
        shared.filter("depth > 0").select("px", "py", F.lit(0).alias("lone")))
    children = below.groupBy(F.col("px").alias("dx"), F.col("py").alias("dy")).agg(
        F.count(F.lit(1)).alias("n_children"), F.sum("lone").alias("lone"))
    tree = shared.join(children, _NODE, "left").withColumns({
        "n_children": F.coalesce("n_children", none),
        "leaves": F.coalesce("lone", none) + F.col("n_children").isNull().cast("long"),
        "saved": (F.col("n_convs") - 1) * F.col("bytes")})
    tree = stage(by_key(tree, parents, ["px", "py"], F.col("above"), total, "left"), "tree")

    path = running(tree, "conv_id", [F.col("depth").desc()], sums=["leaves", "saved"], name="paths",
                   keep=["dx", "dy", "depth", "parent_conv_id", "n_convs", "n_children"])
    tops = stage(tree.groupBy("conv_id").agg(
        F.min("depth").alias("top"), F.sum("leaves").alias("more_leaves"),
        F.sum("saved").alias("more_saved")).filter("top > 0").join(convs, "conv_id"), "tops")
    above = by_key(maybe.select("conv_id", "depth", *_NODE), tops, ["conv_id"], F.col("length"), total).filter(
        "depth < top").select(*_NODE, "more_leaves", "more_saved")
    above = above.unionByName(tops.agg(
        F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved")).select(
        none.alias("dx"), none.alias("dy"), "more_leaves", "more_saved"))
    above = above.groupBy(*_NODE).agg(
        F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved"))
    ends = maybe.filter("depth = length").select(*_NODE, "conv_id").unionByName(
        convs.filter("length = 0").select(none.alias("dx"), none.alias("dy"), "conv_id"))

    many = path.join(above, _NODE, "left").join(_digests_of_ends(ends), _NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaves") + F.coalesce("more_leaves", none)).alias("n_leaves"),
        (F.col("saved") + F.coalesce("more_saved", none)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
    last = F.col("depth") == F.col("length")
    one = F.lit(1).cast("long")
    return many.unionByName(singles.select(
        "conv_id", "depth", "parent_conv_id", one.alias("n_convs"), (~last).cast("long").alias("n_children"),
        one.alias("n_leaves"), none.alias("saved_tokens"),
        F.sha2(F.when(last, F.col("conv_id").cast("string")).otherwise(""), 256).alias("ends_sha256")))
