"""Words and hashes of whole columns of text with numpy, for use inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19  # text looked at together: its arrays stay in the cache and memory stays small
PIECE_BYTES = 1 << 22  # text of the rows that are written back together
_MASK = (1 << 64) - 1


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[
        column.offset:column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose text has at most `limit` bytes; a longer text is a range of its own."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def pieces(batches: Iterator[pa.RecordBatch], column: int, limit: int = PIECE_BYTES
           ) -> Iterator[pa.RecordBatch]:
    """The batches cut between rows, so that a piece has at most `limit` bytes of text. What is made of a
    piece stays small beside the batch, however long the texts are."""
    for batch in batches:
        for low, high in slices(flat(batch.column(column))[1], limit):
            yield batch.slice(low, high - low)


def classes(*members: str | bytes, high: int = 0) -> np.ndarray:
    """A class per byte: 0 for none, k for the k-th set, `high` for bytes of non-ASCII characters."""
    table = np.zeros(256, np.uint8)
    table[128:] = high
    for k, chars in enumerate(members, 1):
        table[np.frombuffer(chars.encode() if isinstance(chars, str) else chars, np.uint8)] = k
    return table


def tokens(data: np.ndarray, offsets: np.ndarray, table: np.ndarray
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of one class within a row: starts, ends, and the first token of each row (n + 1)."""
    kind = np.zeros(len(data) + 2, np.uint8)
    np.take(table, data, out=kind[1:-1])
    change = kind[1:] != kind[:-1]
    change[offsets] = True
    starts = np.flatnonzero(change[:-1] & (kind[1:-1] != 0))
    ends = np.flatnonzero(change[1:] & (kind[1:-1] != 0)) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(values: np.ndarray) -> np.ndarray:
    """Each 64-bit value with its bits spread, in a new array."""
    x = values ^ (values >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=4)
def _letters(seed: int) -> tuple[np.ndarray, int]:
    draw = np.random.default_rng(seed)
    return draw.integers(1, _MASK, 256, np.uint64), int(draw.integers(1, _MASK, dtype=np.uint64)) | 5


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(seed: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(seed)
    if have is None or len(have[0]) < size:
        base = _letters(seed)[1]
        size = max(size, SLICE_BYTES + 2)

        def series(factor: int) -> np.ndarray:
            out = np.full(size, np.uint64(factor))
            out[0] = 1
            return np.multiply.accumulate(out)

        have = series(base), series(pow(base, -1, 1 << 64))
        if size <= 8 * SLICE_BYTES:
            _powers[seed] = have
    return have


class Rolling:
    """Hashes of any byte ranges of `data`: sums of letters times powers of an odd number mod 2^64."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        letters, _ = _letters(seed)
        power, self.inverse = _power(seed, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(letters[data] * power[:len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Equal for equal byte ranges; the lengths take part."""
        value = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mixed(value + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, all other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


