"""Near-duplicates: what leaves a block, and rows that keep their numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from taskspan.llm import near, pii
from taskspan.llm import text as tx
from taskspan.sources.stage import stage


def hashed(texts):
    words, first = near.words_of(*tx.flat(pa.array(texts)))
    return [words[a:b] for a, b in zip(first[:-1], first[1:])]


def test_a_block_returns_a_forest_of_links():
    """A thousand texts of one passage and groups of copies: at most a link per member."""
    draw = np.random.default_rng(1)
    passage = [f"p{k}" for k in range(24)]
    texts = []
    for group in range(250):
        own = [f"g{group}w{k}" for k in range(8)]
        for copy in range(4):
            text = passage + own
            text[copy] = f"edit{copy}"
            texts.append(" ".join(text))
    texts += [" ".join([*passage, *(f"t{draw.integers(1 << 40)}" for _ in range(8))]) for _ in range(200)]
    kind = np.arange(len(texts))
    one, other = near.joined(hashed(texts), kind, np.zeros(len(texts), np.int64), near.SIMILARITY)
    assert len(one) == 250 * 3
    assert {x // 4 for x, y in zip(one, other)} == set(range(250)) and all(x // 4 == y // 4 for x, y in zip(one, other))


def test_only_members_of_two_blocks_are_compared_across():
    texts = ["a b c d e f g h i j", "a b c d e f g h i k", "a b c d e f g h x j"]
    words = hashed(texts)
    kind = np.arange(3)
    assert len(near.joined(words, kind, np.array([0, 0, 1]), near.SIMILARITY)[0]) == 2
    assert len(near.joined(words, np.array([0, 0, 2]), np.array([0, 0, 0]), near.SIMILARITY)[0]) == 1


def test_closest_partners_and_bounds_hold():
    draw = np.random.default_rng(2)
    texts = []
    for _ in range(60):
        base = [f"w{draw.integers(30)}" for _ in range(draw.integers(5, 40))]
        texts += [" ".join(base), " ".join(w if draw.random() > 0.1 else "z" for w in base)]
    words = hashed(texts)
    bags = np.array([np.bincount((w >> np.uint64(40)).astype(int) % near.BINS, minlength=near.BINS) for w in words])
    block = {"words": np.array([len(w) for w in words]), "class": np.arange(len(words)),
             "part": np.zeros(len(words), int), "bag": bags.astype(np.uint8)}
    some, closest = near.partners(block, near.SIMILARITY)
    for a in range(len(words)):
        mates = [b for b in range(len(words)) if a != b and near.alike(words[a], words[b])]
        assert some[a] or not mates
        assert (closest[a] >= 0) == some[a]


def test_of_buckets_with_the_same_members_one_is_kept(spark):
    """Near copies share many keys; the pairs of equal buckets are the same."""
    sets = {1: (1, 2, 3, 9), 2: (1, 2, 3, 9), 3: (1, 2, 4, 9), 4: (1,), 5: (2, 3), 6: (2, 3), 7: (1, 2, 9)}
    rows = [(key, node) for key, nodes in sets.items() for node in nodes]
    found = near._bucketed(spark.createDataFrame(rows, "key long, node long")).collect()
    assert sorted((r.key, r.node) for r in found) == sorted((k, x) for k in (1, 3, 5, 7) for x in sets[k])
    assert {(r.key, r.n, r.leader) for r in found} == {(1, 4, 1), (3, 4, 1), (5, 2, 2), (7, 3, 1)}


def test_rows_made_by_blocks_grow_with_the_group(spark, monkeypatch):
    """Near copies of a text behind an unlike one that shares a frequent passage with all: what the
    blocks return is a few rows, however large the group and however many blocks there are."""
    made = []
    per_block = near._per_block

    def counted(rows, look, schema):
        out = stage(per_block(rows, look, schema), "made")
        made.append(out.count())
        return out

    monkeypatch.setattr(near, "_per_block", counted)
    passage = [f"p{k}" for k in range(8)]
    unlike = " ".join([*passage, *(f"u{k}" for k in range(30))])
    for size in (24, 96):
        made.clear()
        texts = [unlike]
        for copy in range(size):
            words = [*passage, *(f"w{k}" for k in range(40))]
            words[8 + copy % 40] = f"edit{copy}"
            texts.append(" ".join(words))
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        classes = near.marked(docs, bucket=4).collect()
        assert {r.doc_id: r.class_id for r in classes} == {k: min(k, 1) for k in range(size + 1)}
        assert sum(made) <= 2 * size, made


def test_a_text_of_one_word_repeated_meets_its_near_copies(spark):
    texts = ["x x x x x", "x x x x y", "x x y x x", "y y y y y", "x x x x x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near.marked(docs).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 0}


def test_rows_keep_their_numbers_when_files_are_split_anew(spark, tmp_path):
    rows = [(k, f"text {k % 40} " + " ".join(f"w{k % 40}x{j}" for j in range(12))) for k in range(400)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(path)
    docs = spark.read.parquet(path)
    want = sorted(r.doc_id for r in near.deduplicated(docs).collect())
    was = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
    found, classes = near.deduplicated(docs), near.marked(docs)
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "1")
    try:
        assert sorted(r.doc_id for r in found.collect()) == want == list(range(40))
        assert {r.doc_id: r.class_id for r in classes.collect()} == {k: k % 40 for k in range(400)}
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        if was:
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", was)


def test_long_runs_of_digits_are_no_personal_data_and_no_error():
    zeros = "0" * 5_000
    assert pii.base_spans(f"{zeros}1.1.1.{zeros}255") == [("ip", 0, 5_001 + 5 + 5_003)]
    assert pii.base_spans("9" * 5_000 + ".1.1.1") == []
    assert pii.base_spans("4" * 5_000) == [] and pii.base_spans("+" + "1" * 5_000) == []
    assert pii.base_spans("") == []


def test_stored_numbers(spark):
    stored = near._numbered(stage(spark.range(5).selectExpr("id doc_id", "string(id) text"), "five"))
    assert stored.select("doc").distinct().count() == 5
