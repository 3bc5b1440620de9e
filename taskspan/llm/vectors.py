"""Near-duplicate embeddings by an epsilon grid order join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskspan.llm.components import components
from taskspan.llm.ordering import ranked
from taskspan.sources.stage import stage

COSINE = 0.93
DIMENSIONS = 8  # leading principal dimensions that boxes are drawn in
GRID_DIMENSIONS = 4  # of these, the ones that the grid order sorts by
LEAF = 512  # vectors of the smallest interval
FAN = 8  # intervals that make one of the next level
SAMPLE = 8_192  # vectors that the principal dimensions are fitted to, about
SEED = 7
_DOUBT = 1e-4  # single precision products this near the threshold are computed again in double


def epsilon(cosine: float) -> float:
    """The distance of unit vectors with that cosine, and a little for rounding."""
    return float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-6


def unit(values: np.ndarray) -> np.ndarray:
    """Rows (not zero) at length 1, in double precision; scaled first, so squares don't overflow."""
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def leading(sample: np.ndarray, count: int) -> np.ndarray:
    """The `count` directions (columns, orthonormal) of largest variance of unit vectors."""
    centred = sample - sample.mean(axis=0)
    _, directions = np.linalg.eigh(centred.T @ centred)
    return np.ascontiguousarray(directions[:, ::-1][:, :count])


def usable(column: str, label: str):
    """Vectors that can link: with a label, not empty, all components finite, not all zero."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(column, lambda x: x != 0)
    return F.coalesce(F.col(label).isNotNull() & ~bad & some, F.lit(False))


def _projected(nodes: DataFrame, basis: np.ndarray, dimensions: int, width: float) -> DataFrame:
    """The unit vector, its leading coordinates p0.. and grid cells c0.. of every node.

    Vectors of another length than the sample's use their first coordinates; as in the principal
    dimensions, a distance there is never larger than the whole distance.
    """
    shared = nodes.sparkSession.sparkContext.broadcast(basis)  # dimensions x vector length
    places = [f"p{k}" for k in range(dimensions)]
    cells = [f"c{k}" for k in range(GRID_DIMENSIONS)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = shared.value
        for batch in batches:
            vectors = batch.column("vector")
            size = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            start = np.append(0, np.cumsum(size))
            points = np.zeros((batch.num_rows, dimensions))
            units: list[bytes] = [b""] * batch.num_rows
            for length in np.unique(size).tolist():
                rows = np.flatnonzero(size == length)
                made = unit(flat[start[rows][:, None] + np.arange(length)])
                seen = made @ axes if length == len(axes) else made[:, :dimensions]
                points[rows[:, None], np.arange(seen.shape[1])] = seen
                for row, vector in zip(rows.tolist(), made):
                    units[row] = vector.tobytes()
            grid = np.floor(points / width).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("copies"), batch.column("label"),
                 pa.array(size.astype(np.int32)), pa.array(units, pa.binary()),
                 *(pa.array(c) for c in points.T.copy()),
                 *(pa.array(c) for c in grid.T.copy()[:GRID_DIMENSIONS])],
                ["node", "copies", "label", "size", "unit", *places, *cells])

    kinds = "node long, copies long, label long, size int, unit binary, " + ", ".join(
        [f"{p} double" for p in places] + [f"{c} int" for c in cells])
    return nodes.select("node", "copies", "label", "vector").mapInArrow(project, kinds)


def _boxes(table: DataFrame, number: str, dimensions: int) -> DataFrame:
    """Per interval the least and the largest label, vector length and leading coordinates."""
    names = ["label", "size", *(f"p{k}" for k in range(dimensions))]
    from_rows = "lo_label" not in table.columns
    return table.groupBy(F.col(number).cast("long").alias("id")).agg(
        *(F.min(n if from_rows else f"lo_{n}").alias(f"lo_{n}") for n in names),
        *(F.max(n if from_rows else f"hi_{n}").alias(f"hi_{n}") for n in names))


def _near(dimensions: int, width: float):
    """Whether two boxes (a_, b_) can hold linked vectors."""

    def gap(name: str):
        return F.greatest(F.lit(0.0), F.col(f"b_lo_{name}") - F.col(f"a_hi_{name}"),
                          F.col(f"a_lo_{name}") - F.col(f"b_hi_{name}"))

    square = sum((gap(f"p{k}") * gap(f"p{k}") for k in range(dimensions)), F.lit(0.0))
    meet = [(F.col(f"a_lo_{n}") <= F.col(f"b_hi_{n}")) & (F.col(f"b_lo_{n}") <= F.col(f"a_hi_{n}"))
            for n in ("label", "size")]
    return meet[0] & meet[1] & (square <= width * width)


def interval_pairs(leaves: DataFrame, dimensions: int, width: float) -> DataFrame:
    """Pairs (a, b), a <= b, of leaf intervals that are not provably distant.

    `leaves` has the boxes by id. Intervals of `FAN` make one of the next level, up to a single one;
    then pairs of intervals are refined downwards, each into the pairs of its parts whose boxes come
    near, so a distant pair is skipped with all that is below it. Every level is one equi-join on
    the interval's number and a stored table.
    """
    levels = [leaves]
    while levels[-1].count() > 1:
        above = levels[-1].withColumn("up", F.floor(F.col("id") / FAN))
        levels.append(stage(_boxes(above, "up", dimensions), "boxes"))
    pairs = levels[-1].select(F.col("id").alias("a"), F.col("id").alias("b"))
    for level in levels[-2::-1]:
        parts = level.withColumn("up", F.floor(F.col("id") / FAN).cast("long"))
        left = parts.withColumnsRenamed({c: f"a_{c}" for c in parts.columns})
        right = parts.withColumnsRenamed({c: f"b_{c}" for c in parts.columns})
        pairs = stage(pairs.join(left, F.col("a") == F.col("a_up")).join(
            right, F.col("b") == F.col("b_up")).filter(F.col("a_id") <= F.col("b_id")).filter(
            _near(dimensions, width)).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")), "pairs")
    return pairs


def _forest(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links (row, column) of a 0/1 matrix that connect all that its links connect, without cycles."""
    rows_left, columns_left = linked.any(1), linked.any(0)
    while rows_left.any():
        front = np.array([int(rows_left.argmax())])
        rows_left[front] = False
        while len(front):
            found = np.flatnonzero(linked[front].any(0) & columns_left)
            columns_left[found] = False
            if not len(found):
                break
            yield from zip(front[linked[front][:, found].argmax(0)].tolist(), found.tolist())
            more = np.flatnonzero(linked[:, found].any(1) & rows_left)
            rows_left[more] = False
            if len(more):
                yield from zip(more.tolist(), found[linked[more][:, found].argmax(1)].tolist())
            front = more


def _compared(pairs: DataFrame, leaves: DataFrame, cosine: float) -> DataFrame:
    """Per pair of leaves: (node, links, other): links counts the rows a node links to there, other
    is a node that keeps the linked nodes connected, or null."""

    def side(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        start, stop = column.offsets[0].as_py(), column.offsets[1].as_py()
        rows = column.values.slice(start, stop - start)
        return (*(rows.field(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 3)),
                rows.field(4).to_pylist())

    def matrix(units: list[bytes], longest: int) -> np.ndarray:
        out = np.zeros((len(units), longest))
        for row, vector in enumerate(units):
            values = np.frombuffer(vector)
            out[row, :len(values)] = values
        return out

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                same = batch.column(0)[at].as_py() == batch.column(1)[at].as_py()
                one, other = (side(batch.column(k).slice(at, 1)) for k in (2, 3))
                longest = max(one[3].max(), other[3].max())
                left, right = matrix(one[4], longest), matrix(other[4], longest)
                product = left.astype(np.float32) @ right.T.astype(np.float32)
                linked = product >= cosine - _DOUBT
                linked &= (one[2][:, None] == other[2]) & (one[3][:, None] == other[3])
                i, j = np.nonzero(linked & (product <= cosine + _DOUBT))
                linked[i, j] = np.einsum("ij,ij->i", left[i], right[j]) >= cosine
                if same:
                    np.fill_diagonal(linked, False)
                counts = [(one[0], linked @ other[1])] + ([] if same else [(other[0], one[1] @ linked)])
                trees = [*_forest(linked)]
                tree = np.array(trees, np.int64).reshape(-1, 2)
                nodes = np.concatenate([n[c > 0] for n, c in counts] + [one[0][tree[:, 0]]])
                links = np.concatenate([c[c > 0] for _, c in counts] + [np.zeros(len(tree), np.int64)])
                ends = pa.concat_arrays([pa.nulls(len(nodes) - len(tree), pa.int64()),
                                         pa.array(other[0][tree[:, 1]], pa.int64())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.int64()), pa.array(links, pa.int64()), ends],
                    ["node", "links", "other"])

    data = leaves.select("leaf", "rows")
    both = pairs.join(data.withColumnsRenamed({"leaf": "a", "rows": "rows_a"}), "a").join(
        data.withColumnsRenamed({"leaf": "b", "rows": "rows_b"}), "b")
    return both.select("a", "b", "rows_a", "rows_b").mapInArrow(
        compare, "node long, links long, other long")


def linked_vectors(table: DataFrame, vector_id: str = "vec_id", vector: str = "embedding",
                   label: str = "label", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of `table`.

    Two rows link if their labels are equal and not null, their vectors have equal length and their
    cosine, in double precision, is at least `cosine`. Equal vectors are one node with a count, so
    copies are never paired. Nodes are sorted by label and by the cells, as wide as the distance
    that the cosine allows, of the leading principal dimensions; intervals of that order are joined
    recursively, and pairs of intervals whose boxes lie further apart are skipped. Box distances in
    some orthonormal dimensions never exceed the whole distance, so no link is lost. What is left is
    compared by leaf, and a pair of leaves returns link counts and a spanning forest, not its links.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without a
    label, link with nothing. component_id is the smallest vec_id that links reach (null last); all
    rows with that id are kept. Repeated rows are rows of their own. Extra columns are left out.
    `table` must be read from stored tables, as rows are numbered by their place there.
    """
    width = epsilon(cosine)
    rows = table.select(
        F.monotonically_increasing_id().alias("row"), F.col(vector_id).alias("vec_id"),
        F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    rows = stage(rows.withColumn("ok", usable("vector", "label")), "vectors")
    nodes = stage(rows.filter("ok").groupBy("label", "vector").agg(
        F.min("row").alias("node"), F.count(F.lit(1)).alias("copies")), "nodes")
    total = nodes.count()
    share = min(1.0, SAMPLE / max(1, total))
    drawn = F.pmod(F.xxhash64(F.lit(SEED), "node"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    sample = [r["vector"] for r in nodes.filter(drawn).select("vector").orderBy("vector").collect()]
    common = max({len(v) for v in sample}, key=lambda n: sum(len(v) == n for v in sample), default=1)
    basis = leading(unit(np.array([v for v in sample if len(v) == common] or [[1.0]])), DIMENSIONS)
    dimensions = max(GRID_DIMENSIONS, basis.shape[1])
    basis = np.pad(basis, ((0, 0), (0, dimensions - basis.shape[1])))
    order = [F.col("label"), F.col("size"), *(F.col(f"c{k}") for k in range(GRID_DIMENSIONS)),
             F.col("p0"), F.col("node")]
    placed = ranked(stage(_projected(nodes, basis, dimensions, width), "projected"), order, name="place")
    placed = stage(placed.withColumn("leaf", F.floor(F.col("place") / LEAF).cast("long")), "grid_order")
    boxes = stage(_boxes(placed, "leaf", dimensions), "leaf_boxes")
    leaves = stage(placed.groupBy("leaf").agg(F.collect_list(
        F.struct("node", "copies", "label", "size", "unit")).alias("rows")), "leaves")
    found = stage(_compared(interval_pairs(boxes, dimensions, width), leaves, cosine), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(found.filter("other is not null").select(
        F.col("node").alias("a"), F.col("other").alias("b")))
    known = nodes.join(links, "node", "left").join(parts, "node", "left").select(
        "label", "vector", F.coalesce("component", "node").alias("part"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    joined = rows.filter("ok").join(known, ["label", "vector"]).select("vec_id", "n_links", "part")
    alone = rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                         F.col("row").alias("part"))
    every = stage(joined.unionByName(alone), "vector_parts")
    first = stage(every.groupBy("part").agg(F.min("vec_id").alias("component_id")), "parts")
    return every.join(first, "part").select(
        "vec_id", "n_links", "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
