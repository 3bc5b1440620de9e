"""The prefix trie against a walk over all prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from taskspan.llm import trie
from taskspan.sources.stage import stage

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
           "ends_sha256"]


def walked(rows):
    """All nodes by keeping every prefix of every rebuilt conversation."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(own.get(c - c % 5, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        n = len(members[node])
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = sum(saved[k] for k in children[node]) + (
            (n - 1) * len(node[-1][1].encode()) if node else 0)
    out = []
    for node, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(rebuilt[c]) == len(node))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs),
                    len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **settings):
    got = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), **settings)
    assert got.columns == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=str)


def talks(count, seed=1):
    draw = random.Random(seed)
    rows = []
    for c in range(count):
        kind = draw.random()
        for t in range(draw.randint(1, 12)):
            text = f"line {t}" if kind < 0.4 else f"line {t} {draw.randint(0, 2)}"
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", text if kind < 0.9 else f"{c} {t}"))
    draw.shuffle(rows)
    return rows


def test_all_nodes(spark):
    rows = talks(150)
    assert found(spark, rows) == walked(rows)


def test_a_sketch_that_is_far_too_small_changes_no_row(spark):
    rows = talks(60, seed=2)
    assert found(spark, rows, most_cells=16) == walked(rows)


def test_nulls_ties_repeats_and_missing_families(spark):
    rows = [(7, None, "user", "a"), (7, None, "user", "a"), (7, 1, None, None), (7, 1, "user", "é"),
            (None, 1, "user", "lost"), (0, 3, "user", "x"), (1, 0, "user", "y"), (13, 0, "user", ""),
            (13, 0, "user", "z" * 100_000), (5, 0, "user", "a"), (6, 0, "user", "a"), (8, 0, "user", "a"),
            (9, 0, "user", "a")]
    assert found(spark, rows) == walked(rows)


def test_no_conversations(spark):
    assert found(spark, []) == []


def test_one_conversation(spark):
    rows = [(3, t, "user", str(t)) for t in range(30)]
    assert found(spark, rows) == walked(rows)


def test_two_long_equal_conversations_among_short_ones(spark):
    """A third of all rows each; their paths cross many ranges."""
    rows = [(c, t, "user", f"turn {t}") for c in (20, 35) for t in range(300)]
    rows += [(c, t, "user", f"turn {t}") for c in range(40, 80) for t in range(3)]
    assert found(spark, rows) == walked(rows)


def test_ends_of_a_hot_node(spark):
    rows = [(c, 0, "user", "same") for c in range(400)]
    assert found(spark, rows) == walked(rows)


def test_extra_columns(spark):
    rows = talks(20)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"depth": F.lit("x"), "dx": F.lit(1), "n": F.lit(2)})
    assert sorted((tuple(r) for r in trie.prefix_trie(df).collect()), key=str) == walked(rows)


@pytest.mark.parametrize("parts", ["1", "5"])
def test_running_values_over_ranges(spark, parts):
    rows = stage(spark.range(200).select(
        (F.col("id") % 3).alias("k"), F.col("id").alias("at"), F.col("id").alias("v"),
        (F.col("id") * 7).alias("x")), "running_rows")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = trie.running(rows, "k", [F.col("at")], sums=["v"], xors=["x"], keep=["at"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    for r in got:
        mine = [i for i in range(r["at"] + 1) if i % 3 == r["k"]]
        mixed = 0
        for i in mine:
            mixed ^= i * 7
        assert (r["v"], r["x"], r["own_x"]) == (sum(mine), mixed, r["at"] * 7)
    assert len(got) == 200
