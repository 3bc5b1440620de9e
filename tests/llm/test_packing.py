"""Bit-packed token ids against the tokenizer itself, and exact round trips of the files."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from taskspan.llm import packing
from taskspan.llm import text as tx

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
PARTS = [" ", "  ", "a", "don't", "'s", "é", "ñandú", "1", "\n", "\t", " ", "　", "漢", ".", "word", "😀",
         "<|endoftext|>", "\x1c", "\x00", "\u0085", " ", "ß"]


def plain(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, packing.END]


def coded(encoder, texts):
    return [x.tolist() for x in encoder(*tx.flat(pa.array(texts, pa.string())))]


@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), min_size=1, max_size=20))
@settings(max_examples=150, deadline=None)
def test_pieces_give_the_ids_of_whole_texts(texts):
    assert coded(packing.encoder_of(PATH), texts) == [plain(t) for t in texts]


def test_what_is_forgotten_is_encoded_again(monkeypatch):
    monkeypatch.setattr(packing, "KNOWN", 5)
    encoder, draw = packing.Encoder(PATH), random.Random(4)
    for _ in range(30):
        texts = [" ".join(draw.choice(["Alpha", "beta", "gamma,", "delta", "épsilon", "zeta."])
                          for _ in range(draw.randint(0, 9))) for _ in range(5)]
        assert coded(encoder, texts) == [plain(t) for t in texts]


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 32])
def test_any_width_and_random_access(bits):
    draw = np.random.default_rng(bits)
    docs = [draw.integers(0, 1 << bits, n, np.uint64).astype(np.uint32) for n in (1, 900, 0, 2_500, 33)]
    ids = [4, None, 6, -7, 8]
    whole = packing.record(ids, docs, bits, (3, 5), block_bits=8)
    one, two = packing.records(whole + b"\n" + whole + b"\n")
    assert [d for d, _, _ in one.documents()] == ids
    for (_, _, got), want in zip(two.documents(), docs):
        assert got.tolist() == want.tolist()
    flat = np.concatenate(docs)
    for begin, end in ((0, 0), (5, 700), (255, 257), (len(flat) - 1, len(flat))):
        assert two.ids(begin, end).tolist() == flat[begin:end].tolist()
    assert len(one.payload) == sum(-(-min(256, len(flat) - at) * bits // 8) for at in range(0, len(flat), 256))


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()),
                  key=lambda r: r[1])


def expected(rows):
    """Rows of one doc_id are told apart by the caller: here equal texts only."""
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = plain(text)
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_give_back_every_document(spark):
    draw = random.Random(2)
    rows = [(k, " ".join(draw.choice(PARTS) for _ in range(draw.randint(0, 60)))) for k in range(300)]
    rows += [(1_000, None), (1_001, ""), (None, "lost"), (-5, "first"), (1_002, "long " * 60_000)]
    rows += [(2_000, "same row")] * 200
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns(
        {"start": F.lit("x"), "range": F.lit(1)})
    assert rows_of(packing.encoded(df, PATH, record_ids=500, block_bits=6, file_records=3)) == expected(rows)


def test_one_doc_id_with_several_texts_reruns_alike(spark):
    rows = [(1, f"text {k}") for k in range(50)] + [(0, "zero")]
    runs = [rows_of(packing.encoded(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), PATH))
            for n in (1, 6)]
    assert runs[0] == runs[1] and len(runs[0]) == 51 and runs[0][0][0] == 0


def test_an_empty_table(spark):
    assert rows_of(packing.encoded(spark.createDataFrame([], "doc_id long, text string"), PATH)) == []
