"""Ranked search in K2-treaps against scores of all documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from taskspan.llm import treap

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    return WORD.findall((text or "").translate(LOWER))


def scored(docs, items, top=50):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(w for _, c, _ in counted for w in c)
    out = []
    for item, text in items:
        found = []
        for doc, c, n in counted:
            m = 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                        * (1_000_000_000 * c[w] // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if w in c)
            if score > 0:
                found.append((-score, doc is None, doc))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, k, d, -s) for k, (s, _, d) in enumerate(found[:top], 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, **settings):
    df = treap.ranked_documents(
        spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), **settings)
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def texts(count, seed, words=400):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)]
    odds = [1 / (k + 1) for k in range(words)]
    return [" ".join(draw.choices(vocabulary, odds, k=draw.randint(1, 80))) for _ in range(count)]


@pytest.mark.parametrize("blocks", [{}, {"block_postings": 200}, {"block_docs": 7, "batch_terms": 30}])
def test_every_item_finds_its_best_documents(spark, blocks):
    docs, items = list(enumerate(texts(300, 1))), list(enumerate(texts(12, 2)))
    assert searched(spark, docs, items, **blocks) == scored(docs, items)


def test_ties_repeats_nulls_long_texts_and_one_term_everywhere(spark):
    draw = random.Random(5)
    docs = [(k, "the same Text") for k in range(120)] + [(3, "the same text")] * 5
    docs += [(None, "the Ünique text"), (500, None), (501, ""), (502, "... --- "), (503, "the " * 40_000 + "rare")]
    docs += [(600 + k, f"the{k % 3} ÜNIQUE x{k}") for k in range(30)]
    draw.shuffle(docs)
    items = [(1, "same text"), (1, "same text"), (None, "rare the"), (2, None), (3, "?!"), (4, "Ünique x7 x7"),
             (5, "absent")]
    assert searched(spark, docs, items, block_postings=60) == scored(docs, items)


def test_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == []
    assert searched(spark, [(1, "a b"), (2, "c")], []) == []


def test_extra_columns(spark):
    docs, items = list(enumerate(texts(40, 3))), list(enumerate(texts(3, 4)))
    found = treap.ranked_documents(
        spark.createDataFrame(docs, DOCS).withColumns({"score": F.lit("x"), "item": F.lit(1)}),
        spark.createDataFrame(items, ITEMS).withColumns({"terms": F.lit(0), "doc_id": F.lit(1)}))
    assert sorted((tuple(r) for r in found.collect()), key=str) == scored(docs, items)


def test_a_treap_holds_each_cell_once_and_no_larger_impact_below():
    draw = np.random.default_rng(1)
    cells = np.unique(draw.integers(0, 32 * 32, 300))
    codes = draw.integers(0, 40, len(cells))
    levels = treap.grown(cells // 32, cells % 32, codes, 5)
    seen, nodes = {}, [(0, 0, 0, 1 << 30)]  # node, its first row and column, the impact above it
    for k, (own, places, quarters) in enumerate(levels):
        size, below, child = 32 >> k, [], 0
        assert len(own) == len(nodes)
        for node, row, column, above in nodes:
            assert own[node] <= above
            place = np.array([places[node]]).astype(np.uint64)
            at = (row + int(treap._gathered(place >> np.uint64(1))[0])) * 32 + column + int(treap._gathered(place)[0])
            seen[at] = own[node]
            for quarter in range(4):
                if quarters[node] >> quarter & 1:
                    below.append((child, row + (quarter >> 1) * size // 2, column + (quarter & 1) * size // 2,
                                  own[node]))
                    child += 1
        nodes = below
    assert seen == dict(zip(cells.tolist(), codes.tolist()))


def test_a_search_looks_at_few_nodes(monkeypatch):
    """Ranges below the least score that counts are left out."""
    rows, columns = np.divmod(np.arange(64 * 4096), 4096)
    codes = np.where(columns < 60, 200, 1 + (rows + columns) % 20)
    impacts = np.arange(201, dtype=np.int64)
    levels = treap.grown(rows, columns, codes, 12)
    block = treap.Block({
        "doc_ids": np.arange(4096).tobytes(), "has_id": np.ones(4096, bool).tobytes(),
        "terms": np.arange(64, dtype=np.uint64).tobytes(), "rows": np.arange(64, dtype=np.uint32).tobytes(),
        "impacts": impacts.tobytes(), "levels": [
            {"codes": c.astype(np.uint16).tobytes(), "places": p.tobytes(), "bits": b.tobytes()}
            for c, p, b in levels]})
    best, seen = treap.Best(50), []
    add = best.add
    monkeypatch.setattr(best, "add", lambda *x: (seen.append(len(x[0])), add(*x)))
    treap.search(block, np.arange(8), np.ones(8, np.int64), best, wide=64)
    assert best.held[:, 2].tolist() == list(range(50)) and set(best.held[:, 0]) == {1600}
    assert sum(seen) < 400
