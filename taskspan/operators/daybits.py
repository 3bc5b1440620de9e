"""Sets of days as bitmaps, 64 days to a word.

Day d (days since 1970-01-01) is bit `d & 63` of word `d >> 6`. Spans are cut into words and the words
of a group are united by `bit_or`, so the state is 8 bytes per group and word however many spans
overlap there, and partial aggregation does most of it before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def word_of(day: Column) -> Column:
    """Word of a day; days before 1970 are in negative words."""
    return F.shiftright(day, 6)


def bit_of(day: Column) -> Column:
    """The bit of a day alone."""
    return F.call_function("shiftleft", _long(1), day.bitwiseAND(63))


def span_bits(first: Column, last: Column, word: Column) -> Column:
    """Bits of the days from first to last, both included, that lie in the word; none if they are the
    wrong way round or missing."""
    start = word * 64
    low = F.greatest(first - start, F.lit(0))
    high = F.least(last - start, F.lit(63))
    bits = F.call_function("shiftleft", _long(-1), low).bitwiseAND(
        F.call_function("shiftrightunsigned", _long(-1), F.lit(63) - high))
    return F.when((first <= last) & (low <= high), bits).otherwise(_long(0))


def lowest_day(bits: Column, word: Column) -> Column:
    """The first day of a word that has any."""
    last = bit_of(F.lit(63))  # the least long, from which nothing can be taken
    below = F.when(bits != last, F.bitwise_not(bits).bitwiseAND(bits - F.lit(1)))
    return word * 64 + F.coalesce(F.bit_count(below), F.lit(63))


def group_words(df: DataFrame, keys: Sequence[str], start: str, complete: str,
                counted: str) -> DataFrame:
    """The days of each group's spans: keys, `word`, `bits`, `first` and `last` (days, of the spans as
    far as they lie in the word), and `named`, the rows of the group with a value in `counted`.

    A row counts in the word of its start. Spans that are the wrong way round have a word without
    bits; rows without a start have the word null.
    """
    begin, end = F.unix_date(F.to_date(F.col(start))), F.unix_date(F.to_date(F.col(complete)))
    rows = df.select(
        *keys, begin.alias("_begin"), end.alias("_end"), F.col(counted).isNotNull().alias("_named"))
    words = F.sequence(word_of(F.col("_begin")), word_of(F.greatest("_begin", "_end")))
    cut = rows.select("*", F.explode_outer(words).alias("word"))
    bits = span_bits(F.col("_begin"), F.col("_end"), F.col("word"))
    valid = F.col("_begin") <= F.col("_end")
    begins = F.coalesce(F.col("word") == word_of(F.col("_begin")), F.lit(True))
    return cut.groupBy(*keys, "word").agg(
        F.coalesce(F.bit_or(bits), _long(0)).alias("bits"),
        F.min(F.when(valid, F.greatest(F.col("_begin"), F.col("word") * 64))).alias("first"),
        F.max(F.when(valid, F.least(F.col("_end"), F.col("word") * 64 + 63))).alias("last"),
        F.count_if(F.col("_named") & begins).alias("named"),
    )


def calendar_words(calendar: DataFrame, off: Column) -> Column:
    """Scalar subquery over a calendar: its first word, the days that are `off` as one word after
    another, and the days that it lacks between its first and its last.

    The arrays are as long as the calendar reaches, one word for 64 days.
    """
    days = calendar.select(F.unix_date(F.to_date(F.col("date"))).alias("day"), off.alias("off"))
    words = days.where(F.col("day").isNotNull()).groupBy(word_of(F.col("day")).alias("word")).agg(
        F.bit_or(bit_of(F.col("day"))).alias("known"),
        F.bit_or(F.when(F.col("off"), bit_of(F.col("day"))).otherwise(_long(0))).alias("off"),
        F.min("day").alias("first"), F.max("day").alias("last"),
    )
    whole = words.agg(
        F.min("first").alias("first"), F.max("last").alias("last"),
        F.map_from_entries(F.collect_list(F.struct("word", F.struct("known", "off")))).alias("words"),
    )
    reach = F.sequence(word_of(F.col("first")), word_of(F.col("last")))
    found = F.col("words")

    def lacking(word: Column) -> Column:
        inside = span_bits(F.col("first"), F.col("last"), word)
        return inside.bitwiseAND(F.bitwise_not(F.coalesce(F.try_element_at(found, word)["known"], _long(0))))

    return whole.select(F.struct(
        word_of(F.col("first")).alias("first"),
        F.transform(reach, lambda w: F.coalesce(F.try_element_at(found, w)["off"], _long(0))).alias("off"),
        F.transform(reach, lacking).alias("lacking"),
    ).alias("calendar")).scalar()


def word_at(words: Column, first: Column, word: Column) -> Column:
    """One word of an array of words that begins with word `first`; none beside it."""
    return F.coalesce(F.get(words, word - first), _long(0))
