"""The parts that need no session, against plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest

from taskspan.llm import archives, decontaminate, near, pii, quality, repeats, sharding, text, toxicity, vectors
from taskspan.llm.tagger import Tagger


def buffer(strings):
    return text.flat(pa.array(strings, pa.string()))


def test_flat_takes_nulls_and_slices():
    column = pa.array(["x", None, "", "äb", "end"]).slice(1, 3)
    data, offsets = text.flat(column)
    assert data.tobytes().decode() == "äb"
    assert offsets.tolist() == [0, 0, 0, 3]


def test_slices_cover_all_rows_and_give_long_texts_their_own():
    offsets = np.append(0, np.cumsum([3, 0, 50, 4, 4, 4]))
    assert list(text.slices(offsets, 10)) == [(0, 2), (2, 3), (3, 5), (5, 6)]
    assert list(text.slices(np.array([0]), 10)) == []


def test_pieces_hold_all_rows_in_order_and_little_text():
    texts = ["abc", None, "d" * 50, "", "efgh", "ij", "klmn"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts, pa.string())], ["k", "text"])
    made = list(text.pieces(iter([batch, batch.slice(0, 0), batch.slice(4)]), 1, 10))
    assert [piece["k"].to_pylist() for piece in made] == [[0, 1], [2], [3, 4, 5, 6], [4, 5, 6]]
    assert pa.Table.from_batches(made)["text"].to_pylist() == texts + texts[4:]


def test_tokens_do_not_cross_rows():
    data, offsets = buffer(["ab", "cd e", "", " f"])
    starts, ends, first = text.tokens(data, offsets, text.classes("abcdef"))
    assert [data[s:e].tobytes() for s, e in zip(starts, ends)] == [b"ab", b"cd", b"e", b"f"]
    assert first.tolist() == [0, 1, 3, 3, 4]


def test_rolling_hashes_agree_only_for_equal_ranges():
    data = np.frombuffer(b"abcabcabd", np.uint8)
    rolling = text.Rolling(data)
    values = rolling.of(np.array([0, 3, 6, 0, 3]), np.array([3, 6, 9, 2, 5]))
    assert values[0] == values[1] != values[2]
    assert values[3] == values[4] != values[0]


def words(strings):
    return [np.array([hash(w) & 0xFFFF for w in s.split()], np.uint64) for s in strings]


@pytest.mark.parametrize("seed", range(8))
def test_automaton_finds_every_window(seed):
    draw = random.Random(seed)
    letters = "abcd"[:2 + seed % 3]
    items = [[draw.choice(letters) for _ in range(draw.randint(0, 9))] for _ in range(5)]
    code = {c: np.uint64(10 + k) for k, c in enumerate(letters)}
    window = draw.randint(2, 4)
    automaton = decontaminate.Automaton(
        [(k, np.array([code[c] for c in item], np.uint64)) for k, item in enumerate(items)], window)
    doc = [draw.choice(letters + "z") for _ in range(300)]
    hashes = np.array([code.get(c, np.uint64(99)) for c in doc], np.uint64)
    found = set()
    for start, run in automaton.runs(hashes, np.array([0, len(doc)])):
        for first, last, ids in automaton.windows(run):
            found.update((start + first, start + last, i) for i in ids)
    expected = set()
    for k, item in enumerate(items):
        size = min(window, len(item))
        for at in range(len(item) - size + 1) if item else ():
            expected.update((p, p + size, k) for p in range(len(doc) - size + 1)
                            if doc[p:p + size] == item[at:at + size])
    assert found == expected


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment_equals_the_full_table():
    draw = random.Random(4)
    for _ in range(400):
        a = [draw.randint(0, 3) for _ in range(draw.randint(0, 12))]
        b = a[draw.randint(0, 2):] if draw.random() < 0.6 else [draw.randint(0, 3) for _ in range(9)]
        b = [x if draw.random() < 0.8 else 7 for x in b]
        for most in range(7):
            assert near.within(a, b, most) == (distance(a, b) <= most)


def test_alike_is_edit_similarity():
    draw = random.Random(5)
    for _ in range(300):
        a = np.array([draw.randint(0, 20) for _ in range(draw.randint(1, 40))])
        b = np.array([x if draw.random() < 0.85 else 99 for x in a.tolist()] + [5] * draw.randint(0, 4))
        expected = 1 - distance(a.tolist(), b.tolist()) / max(len(a), len(b)) >= 0.8 - 1e-9
        assert near.alike(a, b) == expected
    assert not near.alike(np.array([], int), np.array([], int))


def test_labelled_kmers_count_occurrences_and_sketches_ignore_nothing_else():
    hashes, first = near.words_of(*buffer(["a a a a a a a", "a a a a a a a", "x", "", "b a a a a a a a"]))
    labels, start = near.labelled_kmers(hashes, first)
    assert np.diff(start).tolist() == [3, 3, 1, 0, 4]
    assert len(set(labels[:3].tolist())) == 3 and labels[:3].tolist() == labels[3:6].tolist()
    made = near.sketches(labels, start)
    assert (made[0] == made[1]).all() and not made[3].any() and (made[0] != made[2]).all()


def test_sketches_depend_on_the_order_of_the_chosen_kmers():
    labels = np.array([5, 9, 9, 5], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    made = near.sketches(labels, np.array([0, 2, 4]))
    assert (made[0] != made[1]).all()


@pytest.mark.parametrize("name", ["embed", "recur", "out", "bias", "move", "start"])
def test_tagger_gradients(name):
    tagger = Tagger(7, 5, 4)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    draw = np.random.default_rng(0)
    x, y = draw.integers(0, 7, (3, 6)), draw.integers(0, 5, (3, 6))
    _, grad = tagger.loss(x, y)
    for _ in range(4):
        at = tuple(draw.integers(0, n) for n in tagger.p[name].shape)
        old, sides = tagger.p[name][at], []
        for step in (1e-5, -1e-5):
            tagger.p[name][at] = old + step
            sides.append(tagger.loss(x, y)[0])
        tagger.p[name][at] = old
        assert abs((sides[0] - sides[1]) / 2e-5 - grad[name][at]) < 1e-6


def test_decoding_is_the_best_of_all_paths():
    tagger = Tagger(4, 3, 3)
    tagger.p["move"] += np.random.default_rng(1).normal(0, 1, (3, 3)).astype(np.float32)
    x = np.array([[0, 1, 3, 2]])
    scores = tagger.emissions(x)[0][0]
    paths = np.array(np.meshgrid(*[range(3)] * 4)).reshape(4, -1).T
    value = [tagger.p["start"][p[0]] + sum(scores[t, p[t]] for t in range(4)) + sum(
        tagger.p["move"][p[t], p[t + 1]] for t in range(3)) for p in paths]
    assert tagger.decode(x)[0].tolist() == paths[int(np.argmax(value))].tolist()


def test_base_patterns():
    card = "4111 1111 1111 1111"
    found = pii.base_spans(f"é a.b+c@x-y.co.uk, 10.0.0.255, 300.1.1.1; {card}; +1 (988) 555-2485. a@b @c.d 1.2.3")
    assert [k for k, _, _ in found] == ["email", "ip", "card", "phone"]
    assert found[0][1:] == (2, 17)
    assert pii.base_spans("x@y.z@q.r 4111 1111 1111 1112 +1 23") == [("email", 0, 5)]
    assert pii.base_spans("") == []


def test_windows_cover_every_mark_and_reconcile_whole_spans():
    value = "x" * 130 + " 4111 1111 1111 1111 " + "y" * 200
    coded = pii.symbols(value)
    starts = pii.windows(coded)
    tags = pii.tags_of(len(value), [("card", 131, 150)])
    cut = np.append(tags, np.zeros(pii.WINDOW, np.uint8))[starts[:, None] + np.arange(pii.WINDOW)]
    assert list(pii.reconciled(len(value), starts, cut)) == [("card", 131, 150)]
    assert len(pii.windows(pii.symbols("no marks here"))) == 0
    assert len(pii.windows(pii.symbols(""))) == 0


@pytest.mark.parametrize("size", [0, 1, 8191, 8192, 8193, 50_000])
def test_chunked_framing_round_trip(size):
    body = bytes(random.Random(size).randbytes(size))
    assert archives.dechunked(archives.chunked(body)) == body


def test_broken_chunks_are_errors():
    for framed in (b"5\r\nab", b"zz\r\n", b"2\r\nabXX0\r\n\r\n", b""):
        with pytest.raises(ValueError):
            archives.dechunked(framed)


def test_ring_gives_every_shard_its_capacity_and_moves_little():
    counts = {k: 10 + k % 7 for k in range(24 * 16)}
    total = sum(counts.values())
    for shards in (24, 25):
        nodes = sharding.ring(shards, 16)
        runs = sharding.overflow(nodes, {k: v for k, v in counts.items()}, sharding.capacities(total, shards))
        by = {}
        for node, first, last, shard, slot in runs:
            by.setdefault(shard, []).append((slot, last - first))
        for pieces in by.values():
            at = 0
            for slot, size in sorted(pieces):
                assert slot == at
                at += size
        sizes = [sum(n for _, n in by[s]) for s in range(shards)]
        assert sum(sizes) == total and max(sizes) - min(sizes) <= 1
    old = dict(sharding.ring(24, 16))
    assert old.items() <= dict(sharding.ring(25, 16)).items()


def test_overflow_with_one_hot_arc():
    nodes = sharding.ring(4, 2)
    runs = sharding.overflow(nodes, {3: 1000}, sharding.capacities(1000, 4))
    assert sorted(last - first for _, first, last, _, _ in runs) == [250] * 4
    assert sharding.overflow(nodes, {}, sharding.capacities(0, 4)) == []


def test_best_cut():
    assert quality.best_cut(np.array([-9.0, -8, 1, 2]), np.array([False, False, True, True])) == -3.5
    assert quality.best_cut(np.array([1.0, 2]), np.array([True, True])) == float("-inf")
    assert quality.best_cut(np.array([]), np.array([], bool)) == float("-inf")


def test_log_ratio_says_nothing_about_what_the_target_is_too_small_to_hold():
    ratio = quality.log_ratio(np.array([50.0, 0, 0]), np.array([5000.0, 10, 5000]))
    assert abs(ratio[1]) < 0.05 and ratio[2] < -1 < 0 < ratio[0]


def test_repeated_tokens_share_an_ngram():
    one, _ = quality.ngrams(*buffer(["foo foo"]), 1 << 14)
    other, _ = quality.ngrams(*buffer(["bar bar"]), 1 << 14)
    assert set(one.tolist()) & set(other.tolist())


def test_chosen_suffixes_are_the_same_for_equal_windows():
    draw = random.Random(2)
    passage = "".join(draw.choice("abcdefgh ") for _ in range(260))
    data, offsets = buffer([f"xx{passage}yyy", f"{'z' * 77}{passage}", "short", "a" * 500])
    row, place, first, last, head = repeats.chosen(data, offsets, 200)
    for k in range(len(row)):
        assert offsets[row[k]] <= first[k] <= last[k] <= place[k] and last[k] + 200 <= offsets[row[k] + 1]
    windows = sum(max(0, n - 199) for n in np.diff(offsets))
    assert (last - first + 1).sum() == windows
    shared = [{int(place[k] - offsets[0] - 2) for k in np.flatnonzero(row == 0) if 2 <= first[k] and last[k] <= 62},
              {int(place[k] - offsets[1] - 77) for k in np.flatnonzero(row == 1) if first[k] >= offsets[1] + 77}]
    assert shared[0] & shared[1]


def test_forest_connects_what_the_links_connect():
    draw = np.random.default_rng(6)
    for _ in range(60):
        linked = draw.random((9, 7)) < 0.15
        edges = list(vectors._forest(linked))
        assert all(linked[i, j] for i, j in edges)

        def parts(pairs):
            root = list(range(16))
            def find(x):
                while root[x] != x:
                    x = root[x]
                return x
            for i, j in pairs:
                root[find(i)] = find(9 + j)
            return [find(x) for x in range(16)]

        a, b = parts(edges), parts(zip(*np.nonzero(linked)))
        assert [a[i] == a[j] for i in range(16) for j in range(16)] == [
            b[i] == b[j] for i in range(16) for j in range(16)]
        assert len(edges) == sum(1 for _ in edges) <= 15


def test_features_of_empty_and_toxic_texts():
    data, offsets = buffer(["", "YOU are an idiot!!", "st*pid", "idiot at home, far away from any other word of yours"])
    found = toxicity.dense(data, offsets, np.zeros(0, np.uint64), np.zeros(0))
    named = dict(zip(toxicity.FEATURES, found.T))
    assert not found[0].any()
    assert named["near_you"][1] > 0 and named["near_you"][3] == 0
    assert named["capitals"][1] > 0 and named["shouting"][1] > 0 and named["obfuscation"][2] > 0
