"""Rows whose key may be among others, told before they are shuffled.

A key is one bit of a bitmap, at the place its hash gives. The bitmap is a stored table of one row that
plans read as a scalar, so a large table meets it while it is scanned. It keeps all rows with a
key and few without; a join must follow. Its size follows the number of keys up to a bound; with more keys it
only keeps more rows. Few keys make no bitmap: what is joined with them is broadcast anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskspan.sources.stage import stage

LEAST_KEYS = 1 << 16  # fewer rows of keys are a broadcast, and the join itself shuffles nothing
BITS_PER_KEY = 8
LEAST_WORDS, MOST_WORDS = 1 << 6, 1 << 20  # 64 bits each: at most 8 MB
_PIECE = 10  # words that are put in order together, as a power of two

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _place(df: DataFrame, columns: tuple[str, ...], words: int) -> Column:
    """The bit of a key; whole numbers of any width have the same."""
    key = [F.col(c).cast("long") if isinstance(df.schema[c].dataType, _WHOLE) else F.col(c) for c in columns]
    return F.pmod(F.xxhash64(*key), F.lit(64 * words))


class KeyFilter:
    """The keys in one or more columns of a table, which is read twice: pass a stored one."""

    def __init__(self, keys: DataFrame, *columns: str):
        self.columns, self.kind = columns, _kind(keys, columns)
        rows = keys.count()
        self.words = min(max(1 << (rows * BITS_PER_KEY // 64).bit_length(), LEAST_WORDS), MOST_WORDS)
        self.bits = None if rows < LEAST_KEYS else _bitmap(keys.select(_place(keys, columns, self.words).alias("_bit")), self.words)

    def held(self, df: DataFrame) -> Column | None:
        """Whether the key of a row may be among the keys, never null. None with few keys, or where a join
        would have to turn text into numbers to compare them."""
        if self.bits is None or _kind(df, self.columns) != self.kind:
            return None
        place = _place(df, self.columns, self.words)
        word = F.get(self.bits.scalar(), F.shiftright(place, 6).cast("int"))
        return F.getbit(word, (place % 64).cast("int")) == 1

    def may_hold(self, df: DataFrame) -> DataFrame:
        """The rows of `df` whose key may be among the keys; `df` as it is where that can't be told."""
        held = self.held(df)
        return df if held is None else df.where(held)


def _kind(df: DataFrame, columns: tuple[str, ...]) -> list[str]:
    kinds = [df.schema[c].dataType for c in columns]
    return ["whole" if isinstance(kind, _WHOLE) else kind.simpleString() for kind in kinds]


def _bitmap(bits: DataFrame, words: int) -> DataFrame:
    """One row, stored, with all words in order. Only the words meet in one task, in pieces."""
    marks = bits.select(F.shiftright("_bit", 6).alias("word"),
                        F.expr("shiftleft(1L, cast(_bit % 64 as int))").alias("bits"))
    none = bits.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    dense = marks.unionAll(none).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    pieces = dense.groupBy(F.shiftright("word", _PIECE).alias("piece")).agg(
        F.sort_array(F.collect_list(F.struct("word", "bits"))).getField("bits").alias("bits"))
    return stage(pieces.agg(F.flatten(
        F.sort_array(F.collect_list(F.struct("piece", "bits"))).getField("bits")).alias("bits")), "key-bits")
