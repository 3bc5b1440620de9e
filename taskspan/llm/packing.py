"""Token ids in binary files: fixed-width bit packing with block offsets, in the order of doc_id.

A file is a row of records, each followed by one line end (the text sink writes it). A record holds
whole documents and, little-endian:

    header   magic 'IDS1', bits a number, log2 of the ids of a block, two zero bytes,
             length of the record (8), range (4), record in the range (4), documents (8), ids (8)
    index    doc_id of each document (8), 1 if it has one else 0 (1), first id of each document and
             the number of all ids (8)
    blocks   first byte of each block in the payload and the size of the payload (8)
    payload  the ids of one block after the other, each block from a byte of its own, the lowest bit
             of an id first

So the ids [begin, end) of a document are read from the blocks that hold them alone.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskspan.llm import text as tx
from taskspan.sources.stage import stage, stage_path

MAGIC = b"IDS1"
END = 0  # the id behind every document
BLOCK_BITS = 12  # 4,096 ids of a block
RECORD_IDS = 1 << 18  # a record is closed once it holds so many ids
FILE_RECORDS = 32
BATCH_BYTES = 1 << 23  # text that is encoded together
KNOWN = 1 << 18  # pieces of text a worker remembers the ids of, and as many that it met before
ROW = 512  # pieces that are encoded in a row
_HEAD = struct.Struct("<4sBBHQIIQQ")


def width_of(size: int) -> int:
    """Bits that hold every id below `size`."""
    return max(1, (size - 1).bit_length())


def packed(ids: np.ndarray, bits: int) -> bytes:
    """The ids one after the other in `bits` bits each, filled up to a whole byte."""
    spread = (ids[:, None].astype(np.uint32) >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpacked(data: np.ndarray, bits: int, count: int) -> np.ndarray:
    """The first `count` ids of packed bytes."""
    one = np.unpackbits(data, count=bits * count, bitorder="little").reshape(count, bits)
    lanes = np.zeros((count, 32), np.uint8)
    lanes[:, :bits] = one
    return np.packbits(lanes, axis=1, bitorder="little").view("<u4").ravel()


class Record:
    """One record of a file; ids are unpacked only where they are asked for."""

    def __init__(self, data: memoryview):
        _, self.bits, block_bits, _, self.length, self.range, self.number, docs, self.n_ids = (
            _HEAD.unpack_from(data))
        self.block = 1 << block_bits
        at = _HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.has_id = np.frombuffer(data, np.uint8, docs, at + 8 * docs).astype(bool)
        self.first = np.frombuffer(data, "<i8", docs + 1, at + 9 * docs)
        at += 17 * docs + 8
        blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(data, "<i8", blocks + 1, at)
        at += 8 * (blocks + 1)
        self.payload = np.frombuffer(data, np.uint8, int(self.offsets[-1]), at)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """The ids [begin, end) of the record."""
        low, high = begin // self.block, -(-end // self.block)
        parts = [unpacked(self.payload[self.offsets[k]:self.offsets[k + 1]], self.bits,
                          min(self.block, self.n_ids - k * self.block)) for k in range(low, high)]
        whole = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        return whole[begin - low * self.block:end - low * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first id, ids) of each document, a stretch of the payload at a time."""
        stretch = 16 * self.block
        held, start = self.ids(0, min(stretch, self.n_ids)), 0
        for k, (doc_id, has_id) in enumerate(zip(self.doc_ids.tolist(), self.has_id.tolist())):
            begin, end = int(self.first[k]), int(self.first[k + 1])
            if end > start + len(held):
                start = begin
                held = self.ids(begin, min(max(end, begin + stretch), self.n_ids))
            yield doc_id if has_id else None, begin, held[begin - start:end - start]


def record(doc_ids: list[int | None], ids: list[np.ndarray], bits: int, place: tuple[int, int],
           block_bits: int = BLOCK_BITS) -> bytes:
    """The bytes of a record; `place` is its range and its number there."""
    first = np.append(0, np.cumsum([len(x) for x in ids]))
    whole = np.concatenate([np.zeros(0, np.uint32), *ids])
    blocks = [packed(whole[at:at + (1 << block_bits)], bits) for at in range(0, len(whole), 1 << block_bits)]
    offsets = np.append(0, np.cumsum([len(b) for b in blocks])).astype("<i8")
    body = b"".join([
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is not None for d in doc_ids], np.uint8).tobytes(),
        first.astype("<i8").tobytes(), offsets.tobytes(), *blocks])
    return _HEAD.pack(MAGIC, bits, block_bits, 0, _HEAD.size + len(body), *place,
                      len(doc_ids), len(whole)) + body


def records(data: bytes | memoryview) -> Iterator[Record]:
    """The records of a file."""
    view, at = memoryview(data), 0
    while at < len(view):
        if bytes(view[at:at + 4]) != MAGIC:
            raise ValueError(f"no record starts at byte {at}")
        one = Record(view[at:])
        yield one
        at += one.length + 1


# Blanks (and other controls) below, and lead bytes of characters among which no blank is.
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_AFTER = _PLAIN.copy()
_AFTER[0xC3:0xE0] = _AFTER[0xE4:0xF5] = True


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the texts may be cut without a change of their ids, and the first piece of each row.

    A byte-level pattern never joins a blank with the character in front of it unless that is a blank
    too. So texts are cut before each single space between two other characters.
    """
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        plain = _PLAIN[data]
        wide = np.zeros(len(data), bool)
        wide[1:] = (data[1:] >= 0x80) & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
        cut[1:-2] = (data[1:-1] == 0x20) & (plain | wide)[:-2] & _AFTER[data[2:]]
    cut[offsets] = True
    cuts = np.flatnonzero(cut)
    return cuts, np.searchsorted(cuts, offsets)


class Encoder:
    """Ids of whole texts; a piece that repeats is encoded once per batch, many only once.

    Pieces between spaces are encoded several in a row, and the bytes that each id stands for tell
    where a piece ends; the other pieces, such as the first of a text, are encoded one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        size = max(self.model.get_vocab_size(with_added_tokens=True), END + 1)
        self.bits = width_of(size)
        special = {k for k, v in self.model.get_added_tokens_decoder().items()}
        self.bytes = np.zeros(size, np.int64)
        for token, k in self.model.get_vocab(with_added_tokens=True).items():
            self.bytes[k] = len(token.encode() if k in special else token)  # a letter per byte
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes()
                for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, texts: list[bytes]) -> list[bytes]:
        """The ids of pieces that are not known."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        end = np.cumsum(size)
        good = size > 2
        at, last = np.where(good, end - size, 0), np.where(good, end - 1, 2)
        wide = (data[last] >= 0x80) & (data[last - 1] >= 0xC3) & (data[last - 1] < 0xE0) if len(data) > 2 else False
        if len(data) > 2:
            good &= (data[at] == 0x20) & _AFTER[data[at + 1]] & (_PLAIN[data[last]] | wide)
        found = [b""] * len(texts)
        alone = np.flatnonzero(~good).tolist()
        for k, ids in zip(alone, self._ids([texts[k].decode() for k in alone])):
            found[k] = ids
        regular = np.flatnonzero(good)
        rows = [regular[at:at + ROW] for at in range(0, len(regular), ROW)]
        lists = [[texts[k] for k in row.tolist()] for row in rows]
        for row, ids in zip(rows, self._ids([b"".join(x).decode() for x in lists])):
            reached = np.cumsum(self.bytes[np.frombuffer(ids, "<u4")])
            at = [0, *((np.searchsorted(reached, np.cumsum(size[row])) + 1) * 4).tolist()]
            for k, a, b in zip(row.tolist(), at[:-1], at[1:]):
                found[k] = ids[a:b]
        return found

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each row, END at its end."""
        bounds, first = pieces(data, offsets)
        words = pa.Array.from_buffers(
            pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        texts = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > KNOWN:  # what is met again moves on, the rest is forgotten
            self.older, self.known = self.known, {}
        found = list(map(self.known.get, texts))
        new = [k for k, ids in enumerate(found) if ids is None]
        named = [texts[k] for k in new]
        ids = list(map(self.older.get, named))
        fresh = [k for k, x in enumerate(ids) if x is None]
        for k, x in zip(fresh, self._fresh([named[k] for k in fresh])):
            ids[k] = x
        for k, x in zip(new, ids):
            found[k] = x
        self.known.update(zip(named, ids))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        begin = np.append(0, np.cumsum(sizes))
        code = coded.indices.to_numpy(zero_copy_only=False)
        length = sizes[code]
        ends = np.append(0, np.cumsum(length))
        ids = flat[np.arange(ends[-1]) + np.repeat(begin[code] - ends[:-1], length)]
        at = ends[first]
        end = np.array([END], np.uint32)
        return [np.concatenate([ids[a:b], end]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


@lru_cache(maxsize=1)  # the tasks of a worker share what it knows
def encoder_of(path: str) -> Encoder:
    return Encoder(path)


def write_ids(docs: DataFrame, folder: str, tokenizer: str, record_ids: int = RECORD_IDS,
              block_bits: int = BLOCK_BITS, file_records: int = FILE_RECORDS) -> None:
    """Encode every row of `docs` (doc_id, text) and write the ids under `folder`, by doc_id.

    Null doc_ids come last; rows of one doc_id are ordered by a hash of their text, so that equal
    rows alone are interchangeable. The rows are dealt into ranges of that order, a doc_id of many
    rows into several, and a range is a row of records. Null texts are empty and become END alone.
    Extra columns are left out. `tokenizer` is a file of the tokenizers library that all executors
    have. Strings of special tokens in a text become these tokens, as in the library by default.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64(F.coalesce("text", F.lit("")))]
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(parts, *order, "row").sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoder_of(tokenizer), TaskContext.get().partitionId()
        names: list[int | None] = []
        held: list[np.ndarray] = []
        size = number = 0

        def made() -> pa.RecordBatch:
            whole = record(names, held, encoder.bits, (part, number), block_bits)
            return pa.RecordBatch.from_arrays([pa.array([whole], pa.binary())], ["value"])

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            data, offsets = tx.flat(batch.column(1))
            for low, high in tx.slices(offsets, BATCH_BYTES):
                at = offsets[low:high + 1]
                for doc_id, ids in zip(doc_ids[low:high], encoder(data[at[0]:at[-1]], at - at[0])):
                    names.append(doc_id)
                    held.append(ids)
                    size += len(ids)
                    if size >= record_ids:
                        yield made()
                        names, held, size, number = [], [], 0, number + 1
        if names:
            yield made()

    lines = dealt.mapInArrow(write, "value binary").select(F.col("value").cast("string"))
    lines.write.option("lineSep", "\n").option("maxRecordsPerFile", file_records).text(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files of `folder`.

    start counts the ids of all documents before it, END included; the files hold no such number, so
    the sizes of ranges and records are summed up here. ids_crc32 is taken of the ids as unsigned
    32-bit numbers.
    """
    files = spark.read.format("binaryFile").load(folder).select("content")
    kinds = [("range", pa.int32()), ("record", pa.int32()), ("first", pa.int64()), ("doc_id", pa.int64()),
             ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for one in records(memoryview(content.as_buffer())):
                    rows = [(one.range, one.number, first, doc_id, len(ids), zlib.crc32(ids.astype("<u4")))
                            for doc_id, first, ids in one.documents()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), kinds)], [n for n, _ in kinds])

    held = stage(files.mapInArrow(
        read, "range int, record int, first long, doc_id long, n_tokens long, ids_crc32 long"), "read_ids")
    sizes = held.groupBy("range", "record").agg(F.sum("n_tokens").alias("ids"))
    ranges = sizes.groupBy("range").agg(F.sum("ids").alias("all_ids"))
    before = F.sum("all_ids").over(Window.orderBy("range")) - F.col("all_ids")  # one row per range
    inside = F.sum("ids").over(Window.partitionBy("range").orderBy("record")) - F.col("ids")
    starts = sizes.withColumn("inside", inside).join(
        ranges.select("range", before.alias("before")), "range").select(
        "range", "record", (F.col("before") + F.col("inside")).alias("start"))
    return held.join(stage(starts, "record_starts"), ["range", "record"]).select(
        "doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def encoded(docs: DataFrame, tokenizer: str, **settings) -> DataFrame:
    """Write the ids of `docs` and read them back: one row per row of `docs`, see `read_ids`."""
    folder = stage_path(docs.sparkSession, "token_ids")
    write_ids(docs, folder, tokenizer, **settings)
    return read_ids(docs.sparkSession, folder)
