"""Leaf-wise quantile trees over stored category cells.

A cell is a distinct row of category codes and days with its number of training rows. The cells lie in
blocks of numpy columns on the executors. For each batch of leaves one job adds up, per leaf and
category, the rows and those above the running score; the driver orders the categories of a leaf by
their share, finds the best cut, and splits the leaves of the largest gains. All sums are whole
numbers, so a tree does not depend on how the cells are dealt.

Growing takes some ten jobs a tree, each of which costs more than the sums of millions of cells. Where
one task can hold all cells (TASK_ROWS), that task grows many trees by the same steps instead of
reporting each sum.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TASK_ROWS = 16_000_000  # cells that one task may hold, some 70 bytes each while they are put in order
SPREAD_ROWS = 200_000  # cells that a task is worth beyond that
SHARE = 2 / 3  # of the leaves that may be split in one batch
TOGETHER = 1_024  # combinations of features that are counted together
PACKED_ROWS = 1 << 26  # rows whose two sums fit one floating point number
CELLS, FEW = 1_024, 2_048  # of the range of a leaf's residuals; residuals that are put in order
KEPT = 512  # residuals of a leaf that a task reports at a time
MOST_SUMS = 1 << 22  # sums that one job brings together


@dataclass
class Block:
    """Cells as columns: codes from 0 per feature (the last code is missing or unseen)."""

    codes: np.ndarray  # (features, cells)
    actual: np.ndarray
    weight: np.ndarray
    score: np.ndarray


@dataclass
class Split:
    """A node with its cut: `left` tells per code whether it goes to the first child."""

    feature: int
    left: np.ndarray
    low: int
    high: int


@dataclass
class Tree:
    """Splits by node number (the root is 0), and the value of each leaf."""

    splits: dict[int, Split] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """The leaf of each cell of (features, cells) codes."""
        found = np.zeros(codes.shape[1], np.int32)
        held = {0: np.arange(codes.shape[1])}
        for node in sorted(self.splits):  # children have larger numbers than their parent
            split, cells = self.splits[node], held.pop(node)
            first = split.left[codes[split.feature, cells]]
            held[split.low], held[split.high] = cells[first], cells[~first]
        for node, cells in held.items():
            found[cells] = node
        return found

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """The value of the leaf of each cell."""
        table = np.zeros(2 * len(self.splits) + 1)
        for node, value in self.values.items():
            table[node] = value
        return table[self.leaves(codes)]


PACKED = "codes binary, actual binary, weight binary, score binary"


def packed(cells: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """The cells (codes.., actual, weight, score) as one row of PACKED per batch; codes below 0
    become the last one of their feature."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            codes = np.array([np.where(c < 0, n, c) for c, n in zip(columns, sizes)], _code(sizes))
            rest = [c.astype(t) for c, t in zip(columns[len(sizes):], (np.float64, np.int64, np.float64))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.tobytes()]) for x in (codes, *rest)], ["codes", "actual", "weight", "score"])

    return cells.mapInArrow(pack, PACKED)


def _code(sizes: Sequence[int]) -> np.dtype:
    """The smallest numbers that hold the codes of features of so many categories."""
    return np.min_scalar_type(max(sizes, default=0))


def blocks_of(batches: Iterable[pa.RecordBatch], sizes: Sequence[int]) -> Iterator[Block]:
    """The blocks of rows of PACKED."""
    for batch in batches:
        for codes, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            yield Block(np.frombuffer(codes, _code(sizes)).reshape(len(sizes), -1), np.frombuffer(rest[0]),
                        np.frombuffer(rest[1], np.int64), np.frombuffer(rest[2]))


def rescored(rows: DataFrame, sizes: Sequence[int], grown: Sequence[Tree], rate: float) -> DataFrame:
    """Rows of PACKED after the trees have been added to their scores."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(batches, sizes):
            for tree in grown:
                block = with_scores(block, tree, rate)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.tobytes()]) for x in (block.codes, block.actual, block.weight, block.score)],
                ["codes", "actual", "weight", "score"])

    return rows.mapInArrow(score, PACKED)


def told(rows: DataFrame, sizes: Sequence[int], tell: Callable[[Iterator[Block]], Iterable]) -> list:
    """What `tell` yields for the blocks of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in tell(blocks_of(batches, sizes)):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(one)])], ["told"])

    return [pickle.loads(row["told"]) for row in rows.mapInArrow(run, "told binary").collect()]


def _sums(part: Iterable[Block], tree: Tree, wanted: list[int], bins: int, first: np.ndarray) -> np.ndarray:
    """(2, leaves, bins): rows and rows above the score, per wanted leaf and category."""
    out = np.zeros((2, len(wanted) * bins))
    place = np.full(2 * len(tree.splits) + 1, -1)
    place[wanted] = np.arange(len(wanted))
    for block in part:
        leaf = place[tree.leaves(block.codes)]
        cells = np.flatnonzero(leaf >= 0)
        weight = block.weight[cells]
        above = weight * (block.actual[cells] > block.score[cells])
        for codes, start in zip(block.codes, first):
            bin_of = leaf[cells] * bins + start + codes[cells]
            out[0] += np.bincount(bin_of, weight, out.shape[1])
            out[1] += np.bincount(bin_of, above, out.shape[1])
    return out.astype(np.int64).reshape(2, len(wanted), bins)


def _residuals(part: Iterable[Block], tree: Tree, asked: dict[int, tuple[float, float]], kept: int) -> list[tuple]:
    """For each leaf asked for: its number, the rows up to the bracket, all rows, and what `_reported`
    says of those in the bracket."""
    held: dict[int, list] = {leaf: [] for leaf in asked}
    for block in part:
        leaf_of = tree.leaves(block.codes)
        order = np.argsort(leaf_of, kind="stable")
        leaf, start = np.unique(leaf_of[order], return_index=True)
        for name, cells in zip(leaf.tolist(), np.split(order, start[1:])):
            if name in asked:
                held[name].append((block.actual[cells] - block.score[cells], block.weight[cells]))
    out = []
    for name, pieces in held.items():
        if pieces:
            value, weight = (np.concatenate(x) for x in zip(*pieces))
            low, high = asked[name]
            inside = (value > low) & (value <= high)
            out.append((name, int(weight[value <= low].sum()), int(weight.sum()),
                        *_reported(value[inside], weight[inside], kept)))
    return out


@dataclass
class Held:
    """Blocks that one task holds.

    Cells of the same codes and score are always in the same leaf, so the steps of a tree run over
    distinct combinations of them, and small features are counted together.
    """

    blocks: list[Block]

    def __post_init__(self) -> None:
        blocks = self.blocks or [Block(np.zeros((0, 0), np.int32), np.zeros(0), np.zeros(0, np.int64), np.zeros(0))]
        codes = np.concatenate([b.codes for b in blocks], axis=1)
        score = np.concatenate([b.score for b in blocks])
        order, fresh = _combinations(codes, score)
        self._of = (np.cumsum(fresh) - 1).astype(np.int32)
        self._codes, self._score = [_narrow(c[order[fresh]]) for c in codes], score[order[fresh]]
        self._actual = _narrow(np.concatenate([b.actual for b in blocks])[order])
        self._weight = _narrow(np.concatenate([b.weight for b in blocks])[order])
        self._rows = np.bincount(self._of, self._weight, len(self._score))
        self._both = self._rows.sum() < PACKED_ROWS  # both sums fit one number
        self._together = _groups([int(c.max(initial=0)) + 1 for c in self._codes])
        self._joint = [np.ravel_multi_index([self._codes[f] for f in some], shape).astype(np.int32)
                       for some, shape in self._together]
        self._tree: Tree | None = None

    def _follow(self, tree: Tree) -> None:
        above = self._weight * (self._actual > self._score[self._of])
        above = np.bincount(self._of, above, len(self._score))
        self._counts = [self._rows + PACKED_ROWS * above] if self._both else [self._rows, above]
        self._tree = tree
        self._leaf = {0: np.arange(len(self._score), dtype=np.int32)}

    def _members(self, tree: Tree) -> dict[int, np.ndarray]:
        """The combinations of each leaf; a tree that has grown is followed from where it was."""
        if self._tree is not tree:
            self._follow(tree)
        for node in sorted(tree.splits):
            if node in self._leaf:
                split, some = tree.splits[node], self._leaf.pop(node)
                first = split.left[self._codes[split.feature][some]]
                self._leaf[split.low], self._leaf[split.high] = some[first], some[~first]
        return self._leaf

    def sums(self, tree: Tree, wanted: list[int], bins: int, first: np.ndarray) -> np.ndarray:
        members = self._members(tree)
        some = np.concatenate([members[leaf] for leaf in wanted])
        leaf = np.repeat(np.arange(len(wanted)), [len(members[leaf]) for leaf in wanted])
        counts = [count[some] for count in self._counts]
        out = np.zeros((len(counts), len(wanted), bins), np.int64)
        for codes, (features, shape) in zip(self._joint, self._together):
            size = math.prod(shape)
            place = leaf * size + codes[some]
            for kind, count in enumerate(counts):
                found = np.bincount(place, count, len(wanted) * size).astype(np.int64).reshape(-1, *shape)
                for k, feature in enumerate(features):
                    others = tuple(1 + other for other in range(len(shape)) if other != k)
                    out[kind, :, first[feature]:first[feature] + shape[k]] = found.sum(others)
        return np.stack([out[0] % PACKED_ROWS, out[0] // PACKED_ROWS]) if self._both else out

    def quantiles(self, tree: Tree, alpha: float) -> dict[int, float]:
        """The exact alpha-quantile, interpolated, of the residuals of every leaf."""
        return dict.fromkeys(self._members(tree), 0.0) | {
            leaf: _quantile(value, weight, alpha) for leaf, value, weight in self._by_leaf(tree)}

    def _by_leaf(self, tree: Tree) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Residuals and weights of the cells of each leaf that has any."""
        members = self._members(tree)
        leaf = np.zeros(len(self._score), np.int16 if max(members) < 1 << 15 else np.int32)
        for name, some in members.items():
            leaf[some] = name
        leaf = leaf[self._of]
        order = np.argsort(leaf, kind="stable")
        ends = np.cumsum(np.bincount(leaf, minlength=max(members) + 1))
        for name in sorted(members):
            cells = order[ends[name - 1] if name else 0:ends[name]]
            if len(cells):
                yield name, self._actual[cells] - self._score[self._of[cells]], self._weight[cells]

    def add(self, tree: Tree, rate: float) -> None:
        """Add the tree to the scores."""
        for leaf, some in self._members(tree).items():
            self._score[some] += rate * tree.values[leaf]
        self._tree = None


def _combinations(codes: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the cells by codes and score, and which of them begin another combination."""
    def numbered(key: np.ndarray) -> tuple[np.ndarray, int]:
        value, of = np.unique(key, return_inverse=True)
        return of.astype(np.int64), max(1, len(value))

    def dealt(key: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        for code in codes:
            size = int(code.max(initial=0)) + 1
            if count * size >= 1 << 62:
                key, count = numbered(key)
            key *= size
            key += code
            count *= size
        order = np.argsort(key, kind="stable")
        key = key[order]
        return order, np.append(True, key[1:] != key[:-1])[:len(key)]

    order, fresh = dealt(np.zeros(len(score), np.int64), 1)
    ordered = score[order]
    if (fresh[1:] | (ordered[1:] == ordered[:-1])).all():  # the rule: the score follows from the codes
        return order, fresh
    return dealt(*numbered(score))


def _quantile(value: np.ndarray, weight: np.ndarray, alpha: float) -> float:
    """The interpolated quantile of weighted values. Counts over cells of their range find the few that
    have to be put in order."""
    place, below = (int(weight.sum()) - 1) * alpha, 0
    ranks = math.floor(place), math.ceil(place)
    low, high = value.min(), value.max()
    while len(value) > FEW and low < high:
        with np.errstate(over="ignore"):
            scale = CELLS / (high - low)
        if not 0 < scale < np.inf:
            break  # neighbouring floating point numbers, or infinite ones
        cell = np.minimum((value - low) * scale, CELLS - 1).astype(np.int16)
        reached = below + np.cumsum(np.bincount(cell, weight, CELLS))
        first, last = np.searchsorted(reached, ranks, "right")
        inside = (cell >= first) & (cell <= last)
        if inside.all():
            break
        below = int(reached[first - 1]) if first else below
        value, weight = value[inside], weight[inside]
        low, high = value.min(), value.max()
    order = np.argsort(value)
    reached = below + np.cumsum(weight[order])
    low, high = value[order[np.searchsorted(reached, ranks, "right")]]
    share = place - ranks[0]
    return float(low if low == high else (1 - share) * low + share * high)


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same values, as small whole numbers where they are such."""
    for kind in (np.int16, np.int32):
        with np.errstate(invalid="ignore"):
            small = values.astype(kind)
        if (values == small).all():
            return small
    return values


def _groups(sizes: Sequence[int]) -> list[tuple[list[int], list[int]]]:
    """The features dealt into groups of at most TOGETHER combinations, with their sizes."""
    groups: list[tuple[list[int], list[int]]] = []
    for feature in sorted(range(len(sizes)), key=lambda f: (-sizes[f], f)):
        for features, shape in groups:
            if math.prod(shape) * sizes[feature] <= TOGETHER:
                features.append(feature)
                shape.append(sizes[feature])
                break
        else:
            groups.append(([feature], [sizes[feature]]))
    return groups


@dataclass
class Spread:
    """Rows of PACKED on many executors: a job per question."""

    rows: DataFrame
    sizes: Sequence[int]

    def sums(self, *asked) -> np.ndarray:
        return sum(told(self.rows, self.sizes, lambda part: [_sums(part, *asked)]))

    def residuals(self, *asked) -> list[tuple]:
        return [one for some in told(self.rows, self.sizes, lambda part: [_residuals(part, *asked)])
                for one in some]

    def quantiles(self, tree: Tree, alpha: float) -> dict[int, float]:
        return leaf_values(self, tree, alpha)


def best_cuts(sums: np.ndarray, first: np.ndarray, alpha: float, min_leaf: int
              ) -> list[tuple[float, int, np.ndarray, int] | None]:
    """For each leaf of (2, leaves, bins) the (gain, feature, left codes, rows to the left) of its
    best cut, or None.

    The categories of a leaf are ordered by their share of rows above the score; for a squared loss
    of the gradient one of the cuts of that order is the best of all subsets.
    """
    rows, above = sums
    gradient = above - (1 - alpha) * rows
    found: list[tuple[float, int, np.ndarray, int] | None] = [None] * rows.shape[0]
    best = np.full(rows.shape[0], 1e-9)
    for feature, (start, end) in enumerate(zip(first, np.append(first[1:], rows.shape[1]))):
        n, g = rows[:, start:end], gradient[:, start:end]
        total, whole = n.sum(1, keepdims=True), g.sum(1, keepdims=True)
        share = np.where(n > 0, above[:, start:end] / np.maximum(n, 1), np.inf)  # absent ones last
        order = np.argsort(share, axis=1, kind="stable")
        left = np.cumsum(np.take_along_axis(n, order, 1), axis=1)
        left_g = np.cumsum(np.take_along_axis(g, order, 1), axis=1)
        right, right_g = total - left, whole - left_g
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left_g ** 2 / left + right_g ** 2 / right - whole ** 2 / np.maximum(total, 1)
        gain = np.where((left >= min_leaf) & (right >= min_leaf), gain, -np.inf)
        cut = gain.argmax(1)
        for leaf in np.flatnonzero(gain[np.arange(len(cut)), cut] > best):
            k = int(cut[leaf])
            goes = np.zeros(end - start, bool)
            goes[order[leaf, :k + 1]] = True
            if 2 * left[leaf, k] > total[leaf, 0]:  # what the leaf has never seen goes with most rows
                goes[n[leaf] == 0] = True
            best[leaf] = gain[leaf, k]
            found[leaf] = (float(gain[leaf, k]), feature, goes, int(left[leaf, k]))
    return found


def grow(cells: Held | Spread, sizes: Sequence[int], *, alpha: float, leaves: int, max_depth: int, min_leaf: int) -> Tree:
    """A tree without leaf values, grown best first in batches.

    A batch splits the leaves of the largest gains, at most SHARE of all leaves and as many as the
    number of leaves allows. One job sums up the smaller child of each, the other one is what is left
    of the parent. The queue holds the sums of at most `leaves` leaves.
    """
    first = np.append(0, np.cumsum(np.array(sizes) + 1))
    bins, first = int(first[-1]), first[:-1]
    tree = Tree()
    at_once = max(1, MOST_SUMS // bins)
    held = {0: cells.sums(tree, [0], bins, first)[:, 0]}
    depth, cuts = {0: 0}, dict(zip([0], best_cuts(held[0][:, None], first, alpha, min_leaf)))
    while True:
        able = sorted((node for node, cut in cuts.items() if cut and depth[node] < max_depth),
                      key=lambda node: (-cuts[node][0], node))
        count = len(tree.splits) + 1
        batch = able[:min(math.ceil(count * SHARE), leaves - count, at_once)]
        if not batch:
            return tree
        small, large = {}, {}
        for node in sorted(batch):
            _, feature, goes, left_rows = cuts[node]
            low = 2 * len(tree.splits) + 1
            tree.splits[node] = Split(feature, goes, low, low + 1)
            depth[low] = depth[low + 1] = depth[node] + 1
            start = first[feature]
            less = 2 * left_rows <= held[node][0, start:start + len(goes)].sum()
            small[node], large[node] = (low, low + 1) if less else (low + 1, low)
        if len(tree.splits) + 1 >= leaves:
            return tree
        grown = [node for node in small if depth[small[node]] < max_depth]
        if grown:
            own = cells.sums(tree, [small[node] for node in grown], bins, first)
            both = np.concatenate([own, np.stack([held[node] for node in grown], axis=1) - own], axis=1)
            names = [small[node] for node in grown] + [large[node] for node in grown]
            for name, cut in zip(names, best_cuts(both, first, alpha, min_leaf)):
                cuts[name] = cut
            held.update((name, both[:, k]) for k, name in enumerate(names))
        for node in batch:
            del cuts[node], held[node]


def _reported(values: np.ndarray, weights: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Distinct values with the weight up to each; of more than `kept` only so many, the last too."""
    value, of = np.unique(values, return_inverse=True)
    reached = np.cumsum(np.bincount(of, weights, len(value))).astype(np.int64)
    if len(value) <= kept:
        return value, reached, True
    at = np.unique(np.append(np.arange(0, len(value), -(-len(value) // kept)), len(value) - 1))
    return value[at], reached[at], False


def leaf_values(cells: Held | Spread, tree: Tree, alpha: float, kept: int = KEPT) -> dict[int, float]:
    """The exact alpha-quantile, interpolated, of the residuals of every leaf at once.

    Tasks report at most `kept` residuals of a leaf with the rows up to them. Where that is all of
    them the quantile is known; otherwise they bracket its rank, and the next job looks at the
    residuals in the bracket alone. No task and no message holds a leaf.
    """
    brackets: dict[int, tuple[float, float]] = {
        leaf: (-np.inf, np.inf) for leaf in range(2 * len(tree.splits) + 1) if leaf not in tree.splits}
    totals: dict[int, int] = {}
    found: dict[int, float] = {}
    while brackets:
        asked = dict(brackets)

        reports: dict[int, list] = {}
        for name, *rest in cells.residuals(tree, asked, kept):
            reports.setdefault(name, []).append(rest)
        for leaf in asked:
            if leaf not in reports:  # a leaf without rows
                found[leaf] = 0.0
                del brackets[leaf]
                continue
            mine = reports[leaf]
            below = sum(r[0] for r in mine)
            totals.setdefault(leaf, sum(r[1] for r in mine))
            place = (totals[leaf] - 1) * alpha
            values = np.unique(np.concatenate([r[2] for r in mine]))
            least, most = np.zeros(len(values), np.int64) + below, np.zeros(len(values), np.int64) + below
            for _, _, value, reached, _ in mine:
                if len(value):
                    known = np.append(0, reached)
                    at = np.searchsorted(value, values, "right")
                    least += known[at]  # rows up to the value that are sure, and that can be
                    exact = value[np.maximum(at - 1, 0)] == values
                    most += np.where(exact, known[at], known[np.minimum(at + 1, len(reached))])
            if all(r[4] for r in mine):
                low, high = (values[np.searchsorted(least, int(rank), "right")]
                             for rank in (math.floor(place), math.ceil(place)))
                share = place - math.floor(place)
                found[leaf] = float(low if low == high else (1 - share) * low + share * high)
                del brackets[leaf]
                continue
            under = np.flatnonzero(most <= math.floor(place))
            over = np.flatnonzero(least > math.ceil(place))
            brackets[leaf] = (values[under[-1]] if len(under) else brackets[leaf][0],
                              values[over[0]] if len(over) else brackets[leaf][1])
    return found


def with_scores(block: Block, tree: Tree, rate: float) -> Block:
    """The block after the tree has been added to its scores."""
    return Block(block.codes, block.actual, block.weight, block.score + rate * tree.scores(block.codes))


def fitted(cells: Held | Spread, sizes: Sequence[int], *, alpha: float, leaves: int, max_depth: int,
           min_leaf: int) -> Tree:
    """The tree of one round."""
    tree = grow(cells, sizes, alpha=alpha, leaves=leaves, max_depth=max_depth, min_leaf=min_leaf)
    tree.values = cells.quantiles(tree, alpha)
    return tree


def fitted_in_a_row(part: Iterable[Block], sizes: Sequence[int], rounds: int, rate: float, **settings
                    ) -> Iterator[Tree]:
    """The trees of several rounds over cells that one task holds."""
    cells = Held([Block(b.codes, _narrow(b.actual), _narrow(b.weight), b.score) for b in part])
    cells.blocks.clear()  # their cells are held by combination
    for _ in range(rounds):
        tree = fitted(cells, sizes, **settings)
        yield tree
        cells.add(tree, rate)
