"""Text defaults and recodes. Blank tests ignore trailing spaces, as the warehouse does."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def default_for_null(column: Column, default: str | int) -> Column:
    """`default` where the value is missing; a blank value stays."""
    return F.coalesce(column, F.lit(default))


def default_for_blank(column: Column, default: str, *also: str) -> Column:
    """`default` where the value is missing, blank or one of `also`."""
    blank = F.rtrim(column).isin("", *also)
    return F.when(column.isNull() | blank, F.lit(default)).otherwise(column)


def default_for_empty(column: Column, default: str) -> Column:
    """`default` where the value is blank; a missing value stays missing."""
    return F.when(F.rtrim(column) == "", F.lit(default)).otherwise(column)


def has_text(column: Column) -> Column:
    """True where the value is neither blank nor the word None; missing gives NULL, so it drops."""
    return ~F.rtrim(column).isin("None", "")


def recode(column: Column, names: Mapping[str, str]) -> Column:
    """Replace the listed values and keep the others."""
    replaced = None
    for old, new in names.items():
        test = column == old
        replaced = F.when(test, F.lit(new)) if replaced is None else replaced.when(test, F.lit(new))
    return replaced.otherwise(column)


def joined_key(*columns: Column) -> Column:
    """The values joined by '|'; NULL as soon as one of them is."""
    parts: list[Column] = []
    for column in columns:
        parts += [F.lit("|"), column.cast("string")]
    return F.concat(*parts[1:])


def joined_dates(column: Column) -> Column:
    """A date array as text, for sinks that store text."""
    return F.array_join(column.cast("array<string>"), ",")
