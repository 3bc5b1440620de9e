"""Near-duplicate texts by Order MinHash, verified by banded alignment of their words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskspan.llm import text as tx
from taskspan.llm.columns import apart
from taskspan.llm.components import components
from taskspan.sources.stage import stage

SHINGLE = 5  # words of a k-mer unless another size is given
GRAM = 3  # words of a k-mer of the search; an edit touches so many of them
SIMILARITY = 0.8  # 1 - edit distance of the words / words of the longer text
SKETCHES = 80
SAMPLED = 2  # k-mers of one sketch, kept in text order
EXACT = 130  # words of a text up to which the search is exact
BUCKET = 2048  # members of a block; larger buckets are compared block by block
BINS = 128  # counts of the words of a text that bound the edit distance from below
FINE_BINS = 1024  # the same for texts that are at hand
SEED = 29
WORDS = tx.classes(bytes(range(1, 9)) + bytes(range(14, 32)) + bytes(range(33, 127)), high=1)
_FIRST = np.uint64((1 << 27) - 1)  # k-mers looked at together at most
_MOST = np.uint64((1 << 64) - 1)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between blanks, A-Z lower-cased, and the first word of each row."""
    low = tx.lowered(data)
    starts, ends, first = tx.tokens(low, offsets, WORDS)
    return tx.Rolling(low).of(starts, ends), first


def labelled_kmers(words: np.ndarray, first: np.ndarray, size: int = SHINGLE
                   ) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-mers with the number of the occurrence, in text order, and the first k-mer of
    each row. A text of fewer words, but not none, is one k-mer."""
    counts = np.diff(first)
    made = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    start = np.append(0, np.cumsum(made))
    row = np.repeat(np.arange(len(counts)), made)
    at = first[row] + np.arange(len(row)) - start[row]
    padded = np.append(words, np.zeros(size, np.uint64))
    value = np.zeros(len(row), np.uint64)
    for k in range(size):
        inside = at + k < first[row + 1]
        value = tx.mixed(value * np.uint64(3) + np.where(inside, padded[at + k], np.uint64(k)))
    own = tx.mixed(value + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own, kind="stable")
    run = np.append(True, own[order][1:] != own[order][:-1])[:len(own)]
    place = np.arange(len(own))
    occurrence = np.empty(len(own), np.uint64)
    occurrence[order] = (place - np.maximum.accumulate(np.where(run, place, 0))).astype(np.uint64)
    return tx.mixed(value + occurrence * np.uint64(0xD1342543DE82EF95)), start


def sketches(labels: np.ndarray, start: np.ndarray, count: int = SKETCHES,
             sampled: int = SAMPLED) -> np.ndarray:
    """(rows, count) sketches: the `sampled` k-mers of least hash, hashed together in text order.
    Rows without k-mers have zeros."""
    draw = np.random.default_rng(SEED)
    factors = draw.integers(0, _MOST, count, np.uint64) | np.uint64(1)
    rows = np.flatnonzero(np.diff(start))
    out = np.zeros((len(start) - 1, count), np.uint64)
    if not len(rows):
        return out
    begin = start[rows]
    place = np.arange(len(labels), dtype=np.uint64)
    padded = np.append(labels, np.uint64(0))
    for k, factor in enumerate(factors):
        value = ((labels * factor) & ~_FIRST) | place
        chosen = []
        for _ in range(sampled):
            least = np.minimum.reduceat(value, begin)
            at = np.where(least == _MOST, len(labels), (least & _FIRST).astype(np.int64))
            chosen.append(at)
            value[at[at < len(labels)]] = _MOST
        sketch = np.full(len(rows), np.uint64(k + 1))
        for at in np.sort(np.array(chosen), axis=0):
            sketch = tx.mixed(sketch * np.uint64(3) + padded[at])
        out[rows, k] = sketch
    return out


def edits(words: np.ndarray | int, similarity: float) -> np.ndarray:
    """The largest edit distance of alike texts of which the longer one has so many words."""
    return (words * (1 - similarity) + 1e-9).astype(np.int64) if isinstance(words, np.ndarray) else int(
        words * (1 - similarity) + 1e-9)


def prefixes(similarity: float, most: int = EXACT) -> np.ndarray:
    """How many k-mers of least hash a text of 0 .. `most` words has to show.

    Of two texts at e edits the longer one, of n words, has n - GRAM + 1 k-mers, of which an edit
    touches GRAM at most. So n - GRAM + 1 - GRAM * e are common, and if a text of m words shows all
    but so many and one more, the least hash of the common ones is shown by both.
    """
    out = np.zeros(most + 1, np.int64)
    for m in range(1, most + 1):
        longest = int(m / similarity + 1e-9)
        out[m] = max(m - n + GRAM * edits(n, similarity) + 1 for n in range(m, longest + 1))
    return out


def search_keys(words: np.ndarray, first: np.ndarray, similarity: float = SIMILARITY
                ) -> tuple[np.ndarray, np.ndarray]:
    """Keys of every row, and the first key of each row; alike texts share a key.

    That is certain if both have at most EXACT words: up to five words, the text and, for five, the
    text without one of its words; from five words on, the k-mers that `prefixes` asks for. Longer
    texts, and shorter ones that can be alike to them, have sketches. At SIMILARITY at least 0.4 of
    the k-mers are common wherever the edits are, a quarter of all that the two texts have, so that
    one of 80 sketches of two k-mers is common with a probability of 0.99 or more.
    """
    counts = np.diff(first)
    labels, start = labelled_kmers(words, first, GRAM)
    row = np.repeat(np.arange(len(counts)), np.diff(start))
    owners, found = [], []

    shown = prefixes(similarity)
    some = np.flatnonzero(((counts >= 5) & (counts <= EXACT))[row])
    order = some[np.lexsort((labels[some], row[some]))]
    of = row[order]
    rank = np.arange(len(of)) - np.searchsorted(of, of)
    good = rank < shown[counts[of]]
    owners.append(of[good])
    found.append(labels[order[good]])

    for size in range(1, 6):
        rows = np.flatnonzero(counts == size)
        if not len(rows):
            continue
        own = words[first[rows][:, None] + np.arange(size)]
        for left_out in [None, *range(size)] if edits(size, similarity) else [None]:
            value = np.full(len(rows), np.uint64(GRAM))
            for k in range(size):
                if k != left_out:
                    value = tx.mixed(value * np.uint64(3) + own[:, k])
            owners.append(rows)
            found.append(value)

    rows = np.flatnonzero(counts > int(EXACT * similarity) - 1)
    if len(rows):
        begin = np.append(0, np.cumsum(np.diff(start)[rows]))
        inside = np.repeat(start[rows], np.diff(begin)) + np.arange(begin[-1]) - np.repeat(
            begin[:-1], np.diff(begin))
        owners.append(np.repeat(rows, SKETCHES))
        found.append(sketches(labels[inside], begin).ravel())
    owner, found = np.concatenate(owners), np.concatenate(found)
    return found[np.argsort(owner, kind="stable")], np.append(
        0, np.cumsum(np.bincount(owner, minlength=len(counts))))


def within(a: list[int], b: list[int], most: int) -> bool:
    """Whether the edit distance of two sequences is at most `most`.

    Only the band of 2 * most + 1 diagonals around the corner is filled, one column at a time, as
    bits of differences between neighbouring cells (Hyyrö's banded form of Myers' algorithm).
    """
    if len(a) < len(b):
        a, b = b, a
    rows, columns = len(a), len(b)
    if rows - columns > most:
        return False
    most = min(most, rows)
    if not columns:
        return rows <= most
    places: dict[int, int] = {}
    for at, symbol in enumerate(a):
        places[symbol] = places.get(symbol, 0) | 1 << at
    width = 2 * most + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    up, down = mask ^ ((1 << most) - 1), 0  # a cell is one more, one less than the one above it
    distance, lowest = most, rows - most
    bit = top >> 1
    for column in range(columns):
        shift = column - most
        match = places.get(b[column], 0)
        match = (match >> shift if shift >= 0 else match << -shift) & mask
        diagonal = ((((match & up) + up) ^ up) | match | down) & mask
        right_up = down | (mask ^ (diagonal | up))
        right_down = diagonal & up
        if column < lowest:  # follow the lower edge of the band, then the last row
            distance += not diagonal & top
        else:
            distance += bool(right_up & bit) - bool(right_down & bit)
            bit >>= 1
        half = diagonal >> 1
        up = right_down | (mask ^ (half | right_up))
        down = half & right_up
        if distance > most + (columns - column):
            return False
    return distance <= most


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the edit similarity of two word sequences reaches the threshold."""
    longer = max(len(a), len(b))
    most = edits(longer, similarity)
    if not len(a) or not len(b) or abs(len(a) - len(b)) > most:
        return False
    size = min(len(a), len(b))
    unlike = np.flatnonzero(a[:size] != b[:size])
    head = int(unlike[0]) if len(unlike) else size
    a, b = a[head:], b[head:]
    size = min(len(a), len(b))
    if not size:
        return True
    unlike = np.flatnonzero(a[::-1][:size] != b[::-1][:size])
    tail = int(unlike[0]) if len(unlike) else size
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    one, other = Counter(a.tolist()), Counter(b.tolist())
    common = sum(min(n, other[w]) for w, n in one.items())
    if max(len(a), len(b)) - common > most:
        return False
    return within(a.tolist(), b.tolist(), most)


def _nodes(docs: DataFrame, similarity: float) -> DataFrame:
    """(doc, h1, h2, sketches, words, bag) of every row with words; h1 and h2 identify the text, the
    sketches are the keys of the search, and the bag counts its words in BINS bins (to 255)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.flat(batch.column(1))
            for low, high in tx.slices(offsets):
                at = offsets[low:high + 1] - offsets[low]
                part = data[offsets[low]:offsets[high]]
                words, first = words_of(part, at)
                made, start = search_keys(words, first, similarity)
                counts = np.diff(first)
                some = np.flatnonzero(counts)
                bins = np.repeat(np.arange(len(counts)), counts) * BINS + (words >> np.uint64(40)).astype(
                    np.int64) % BINS
                bags = np.minimum(np.bincount(bins, minlength=len(counts) * BINS), 255).astype(np.uint8)
                bags = bags.reshape(-1, BINS)[some]
                texts = [tx.Rolling(part, seed).of(at[:-1], at[1:])[some].view(np.int64)
                         for seed in (1, 2)]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.append(start[some], start[-1]), pa.int32()),
                    pa.array(made.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low).take(pa.array(some)),
                     pa.array(texts[0]), pa.array(texts[1]), lists, pa.array(counts[some], pa.int32()),
                     pa.array([bag.tobytes() for bag in bags], pa.binary())],
                    ["doc", "h1", "h2", "sketches", "words", "bag"])

    return docs.select("doc", "text").mapInArrow(
        sketch, "doc long, h1 long, h2 long, sketches array<long>, words int, bag binary")


@lru_cache(maxsize=32)  # the pairs of a hot text follow each other
def _words(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    return words_of(data, np.array([0, len(data)]))[0]


def _bound(bags: np.ndarray, at: int, rest: np.ndarray) -> np.ndarray:
    """A lower bound of the edit distance of one text and others: the words that one of the two bags
    has more than the other. An edit moves one word."""
    more = bags[rest] - bags[at]
    total = more.sum(1)
    over = (np.abs(more).sum(1) + total) // 2
    return np.maximum(over, over - total)


def _plausible(pairs: DataFrame, profiles: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that can be alike by their numbers of words and their bags, stored."""

    def bags(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [batch.column(k).to_numpy() for k in (2, 3)]
            most = edits(np.maximum(*words).astype(np.int64), similarity)
            more = bags(batch.column(4)) - bags(batch.column(5))
            bound = np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1))
            yield batch.select([0, 1]).filter(pa.array((bound <= most) & (np.abs(words[0] - words[1]) <= most)))

    one, other = (profiles.toDF(x, f"words_{x}", f"bag_{x}") for x in "ab")
    return stage(pairs.join(one, "a").join(other, "b").select(
        "a", "b", "words_a", "words_b", "bag_a", "bag_b").mapInArrow(check, "a long, b long"), "plausible")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are alike; both texts are joined to the pair, sides that hold a
    hot text can be split."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = batch.column(2), batch.column(3)
            good = [alike(*(_words(side[k].as_buffer().to_pybytes()) for side in (one, other)), similarity)
                    for k in range(batch.num_rows)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    side = texts.select("doc", F.col("text").cast("binary").alias("text"))
    both = pairs.join(side.withColumnsRenamed({"doc": "a", "text": "text_a"}), "a").join(
        side.withColumnsRenamed({"doc": "b", "text": "text_b"}), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long")


def _with_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    return rows.join(classes, "node", "left").withColumn("class", F.coalesce("component", "node")).drop(
        "component")


def _bucketed(rows: DataFrame) -> DataFrame:
    """The rows (key, node) of buckets with several members, with n and the smallest node.

    Near copies share most of their keys, so of buckets with the same members one is kept: the others
    hold no other pairs. Members are told by their number, the least, the largest and the exclusive
    or of their hashes, which is exact for up to three; a node must not repeat in a bucket. The sizes
    are stored before they are joined: a join straight on an aggregation would keep its dealing by
    key, and the adaptive skew join could not split a hot bucket.
    """
    sizes = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("leader"), F.max("node").alias("last"),
        F.bit_xor(F.xxhash64("node")).alias("members")).filter("n > 1")
    sizes = stage(sizes.groupBy("n", "leader", "last", "members").agg(F.min("key").alias("key")).select(
        "key", "n", "leader"), "bucket_sizes")
    return stage(rows.join(sizes, "key"), "buckets")


def _mates(at: int, words: np.ndarray, most: np.ndarray, part: np.ndarray, kind: np.ndarray,
           bags: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in `rest` that can be alike to the one at `at` and are of another kind, and their
    bounds less what is allowed. `part` is 0 or 1 where two blocks meet: only the other one counts."""
    rest = rest[(kind[rest] != kind[at]) & (part[rest] != part[at] if part.any() and not part.all() else True)]
    allowed = np.maximum(most[rest], most[at])
    good = np.abs(words[rest] - words[at]) <= allowed
    rest, allowed = rest[good], allowed[good]
    over = _bound(bags, at, rest) - allowed if len(rest) else allowed
    return rest[over <= 0], over[over <= 0]


def partners(block: dict[str, np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Which places of a block have a partner: a node of another class that can be alike by the
    numbers of words and the bags; and for each place the closest such one, or -1."""
    words = block["words"]
    most, bags = edits(words, similarity), block["bag"].astype(np.int16)
    closest = np.full(len(words), -1)
    some = np.zeros(len(words), bool)
    everyone = np.arange(len(words))
    for at in everyone:
        rest, over = _mates(at, words, most, block["part"], block["class"], bags, everyone)
        if len(rest):
            some[at], closest[at] = True, rest[np.argmin(over)]
    return some, closest


def joined(words: list[np.ndarray], kind: np.ndarray, part: np.ndarray, similarity: float
           ) -> tuple[list[int], list[int]]:
    """Links between places of a block whose texts are alike: a forest that connects, with the kinds,
    all that the alike pairs connect. A pair that is connected already is not compared."""
    count = np.array([len(w) for w in words], np.int64)
    most = edits(count, similarity)
    bags = np.zeros((len(words), FINE_BINS), np.int16)
    for row, own in zip(bags, words):
        row[:] = np.minimum(np.bincount((own >> np.uint64(40)).astype(np.int64) % FINE_BINS, minlength=FINE_BINS),
                            1 << 14)
    kind = kind.copy()
    ones, others = [], []
    for at in range(len(words)):
        rest, over = _mates(at, count, most, part, kind, bags, np.arange(at + 1, len(words)))
        for other in rest[np.argsort(over, kind="stable")].tolist():
            if kind[other] != kind[at] and alike(words[at], words[other], similarity):
                ones.append(at)
                others.append(other)
                kind[kind == kind[other]] = kind[at]
    return ones, others


def _blocks(members: DataFrame, bucket: int) -> DataFrame:
    """The members (key, node, class, n, ..) of buckets once per pair of blocks they take part in.

    The members of a bucket are dealt to n / `bucket` blocks, and each two blocks (`low`, `high`)
    meet, so that a task holds two blocks at a time and every two members meet.
    """
    blocks = F.ceil(F.col("n") / bucket).cast("int")
    return members.withColumn("blocks", blocks).withColumn(
        "own", F.pmod(F.xxhash64("node", F.lit(SEED)), "blocks").cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({
            "low": F.least("own", "other"), "high": F.greatest("own", "other"),
            "part": (F.col("own") > F.col("other")).cast("int")}).drop("n", "blocks", "own", "other")


def _per_block(rows: DataFrame, look, schema: str) -> DataFrame:
    """`look` at the rows of each (key, low, high) as one Arrow table; it returns a batch or None."""
    place = ["key", "low", "high"]

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.concat_tables([*left, pa.Table.from_batches([batch])])
            named = [table[name].to_numpy() for name in place]
            change = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in named])) + 1
            bounds = np.append(0, change)
            for start, end in zip(bounds[:-1], bounds[1:]):
                found = look(table.slice(int(start), int(end - start))) if end > start + 1 else None
                if found is not None:
                    yield found
            left = [table.slice(int(bounds[-1]))]
        if left and left[0].num_rows > 1:
            found = look(left[0])
            if found is not None:
                yield found

    return rows.repartition(*place).sortWithinPartitions(*place).mapInArrow(held, schema)


def _profiled(table: pa.Table) -> dict[str, np.ndarray]:
    block = {name: table[name].to_numpy().astype(np.int64) for name in ("words", "class", "part")}
    block["bag"] = np.frombuffer(b"".join(table["bag"].to_pylist()), np.uint8).reshape(-1, BINS)
    return block


def _linked(members: DataFrame, texts: DataFrame, similarity: float, bucket: int) -> DataFrame:
    """(a, b): links between members of different classes, compared within their blocks.

    First the members that have any partner at all are found by their bags; only these get their
    texts. A block returns a forest, at most one link per member.
    """

    def involved(table: pa.Table) -> pa.RecordBatch:
        some, _ = partners(_profiled(table), similarity)
        return table.select(["key", "low", "high", "part", "class", "node"]).filter(
            pa.array(some)).combine_chunks().to_batches(None)[0] if some.any() else None

    def compared(table: pa.Table) -> pa.RecordBatch:
        texts = [x.as_buffer().to_pybytes() for x in table["text"]]
        ends = np.append(0, np.cumsum([len(t) for t in texts]))
        hashes, first = words_of(np.frombuffer(b"".join(texts), np.uint8), ends)
        words = [hashes[x:y] for x, y in zip(first[:-1], first[1:])]
        one, other = joined(words, table["class"].to_numpy(), table["part"].to_numpy(), similarity)
        node = table["node"].to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(node[one]), pa.array(node[other])], ["a", "b"])

    kinds = "key long, low int, high int, part int, class long, node long"
    narrow = stage(_per_block(_blocks(members, bucket), involved, kinds), "involved_members")
    side = texts.select(F.col("doc").alias("node"), F.col("text").cast("binary").alias("text"))
    return _per_block(narrow.join(side, "node").select(*(k.split()[0] for k in kinds.split(", ")), "text"),
                      compared, "a long, b long")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """(doc, class) of every row of `docs` (doc, text) that has words: the smallest doc of its class.

    `docs` must be a stored table. Texts that are equal are one node, and nodes with an equal key
    share a bucket. Every node is first compared with the smallest one that any of its buckets
    holds, which joins large groups of copies with one comparison per member, and with the smallest
    one of its smallest bucket, which joins few copies that hold a frequent k-mer. Buckets that still
    hold several classes are compared whole, block by block: a block compares all members of
    different classes that can be alike and returns a forest of the links it finds. So no bucket is
    cut off, whatever its size, and no pair leaves its block unless it is a link.
    """
    if similarity < SIMILARITY:
        raise ValueError(f"the search finds texts of similarity {SIMILARITY} and more")
    rows = stage(_nodes(docs, similarity), "sketches")
    nodes = rows.groupBy("h1", "h2").agg(
        F.min_by(F.struct("sketches", "words", "bag"), "doc").alias("of"), F.min("doc").alias("node"))
    nodes = stage(nodes.select("h1", "h2", "node", "of.*"), "nodes")
    buckets = _bucketed(nodes.select("node", F.explode(F.array_distinct("sketches")).alias("key")))
    profiles = nodes.select("node", "words", "bag")
    leaders = buckets.filter("node <> leader").groupBy("node").agg(F.array_distinct(F.array(
        F.min("leader"), F.min_by("leader", F.struct("n", "leader")))).alias("leaders"))
    seen = stage(leaders.select(F.explode("leaders").alias("a"), F.col("node").alias("b")), "pairs")
    links = stage(_verified(_plausible(seen, profiles, similarity), docs, similarity), "links")
    classes = stage(components(links), "classes")
    several = stage(_with_class(buckets, classes).groupBy("key").agg(
        F.min("class").alias("low"), F.max("class").alias("high")).filter("low <> high").select("key"),
        "open_keys")
    buckets = stage(buckets.join(several, "key", "left_semi"), "open_buckets")
    members = _with_class(buckets, classes).drop("leader").join(profiles, "node")
    found = stage(_linked(members, docs, similarity, bucket), "links")
    if not found.isEmpty():
        # of links found so far a tree per class is enough
        links = classes.filter("node <> component").select(
            F.col("component").alias("a"), F.col("node").alias("b")).unionAll(found)
        classes = stage(components(links), "classes")
    of_text = _with_class(nodes.select("h1", "h2", "node"), classes).select("h1", "h2", "class")
    return rows.select("doc", "h1", "h2").join(of_text, ["h1", "h2"]).select("doc", "class")


def _numbered(docs: DataFrame) -> DataFrame:
    """`docs` with a number per row, doc, in a stored copy: the number of a row must not change when
    its partition is read again."""
    return stage(docs.withColumn("doc", F.monotonically_increasing_id()), "numbered")


def _marked(numbered: DataFrame, **settings) -> DataFrame:
    """`marked` for a stored table (doc, doc_id, text)."""
    found = near_classes(numbered.select("doc", "text"), **settings)
    rows = stage(numbered.select("doc", "doc_id").join(found, "doc", "left").withColumn(
        "class", F.coalesce("class", "doc")), "row_classes")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc")
    best = stage(rows.groupBy("class").agg(
        F.min(first).alias("first"), F.count(F.lit(1)).alias("class_size")), "class_rows")
    return rows.join(best, "class").select(
        "doc", "doc_id", F.col("first.doc_id").alias("class_id"), "class_size",
        (F.col("doc") == F.col("first.doc")).alias("kept"))


def marked(docs: DataFrame, **settings) -> DataFrame:
    """doc (a number), doc_id, class_id, class_size and kept for every row of `docs`.

    Rows whose texts are alike are linked, and a class is what links connect; class_id is its
    smallest doc_id (null last), and of every class one row with that doc_id is kept. Rows without
    words are never linked. Repeated rows are linked like other equal texts. Extra columns are left
    out. Rows are numbered in a stored copy, so the table may be read in any order again.
    """
    return _marked(_numbered(docs.select("doc_id", "text")), **settings)


def deduplicated(docs: DataFrame, **settings) -> DataFrame:
    """The rows and columns of `docs` that `marked` keeps."""
    numbered = _numbered(apart(docs, "doc_id", "text"))
    gone = _marked(numbered.select("doc", "doc_id", "text"), **settings).filter("not kept").select("doc")
    return numbered.join(gone, "doc", "left_anti").drop("doc").toDF(*docs.columns)
