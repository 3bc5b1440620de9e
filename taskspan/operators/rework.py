"""Business days and the merging of repeated ("rework") tasks.

A group's dates are bitmaps, one word for 64 days, that unite by partial aggregation, so the state of
one group is bounded by the calendar however many rows the group has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskspan.operators.daybits import calendar_words, group_words, lowest_day, word_at
from taskspan.operators.extract import extract_nonworkdays
from taskspan.operators.keyfilter import KeyFilter
from taskspan.schema import DAYS
from taskspan.sources.stage import stage

REPEAT_KEYS = ("orderID", "subIntID")
# Task columns in which the extract can leave a value missing; the others have a default.
NULLABLE_COLUMNS = ("subIntervalName", "owner", "PID", "phaseName")


def repeat_counts(df: DataFrame, keys: Sequence[str] = REPEAT_KEYS,
                  counted: str = "subIntervalName") -> DataFrame:
    """Rows per order and task; missing keys and missing names do not count."""
    named = df.where(" and ".join(f"{k} is not null" for k in keys))
    return named.groupBy(*keys).agg(F.count(counted).alias("count"))


def with_repeat_count(df: DataFrame, keys: Sequence[str] = REPEAT_KEYS) -> DataFrame:
    """Give each row with keys the number of rows of its order and task.

    Most tasks occur once, so only the other counts are stored and joined.
    """
    counts = stage(repeat_counts(df, keys).where(F.col("count") != 1), "repeat-counts")
    keyed = df.where(" and ".join(f"{k} is not null" for k in keys))
    return keyed.join(counts, list(keys), "left").withColumn(
        "count", F.coalesce("count", F.lit(1).cast("long")))


def nonwork_flags(calendar: DataFrame, from_year: int) -> Column:
    """Scalar subquery: the first non-work day of the calendar (days since 1970-01-01) and, for each
    day from there on, whether it is one.

    The array is as long as the calendar reaches and is computed once per query.
    """
    days = extract_nonworkdays(calendar, from_year=from_year).select(
        F.unix_date(F.to_date("date")).alias("day"))
    flags = F.transform(
        F.sequence(F.min("day"), F.max("day")),
        lambda day: F.array_contains(F.collect_set("day"), day),
    )
    return days.agg(F.struct(F.min("day").alias("first"), flags.alias("flags")).alias("off")).scalar()


def _works(day: Column, off: Column) -> Column:
    """Whether a date is a business date; dates the calendar lacks are."""
    return ~F.coalesce(F.get(off["flags"], F.unix_date(day) - off["first"]), F.lit(False))


def dates_between(start: Column, complete: Column, off: Column) -> Column:
    """Business dates from start to complete, both included; empty if they are the wrong way round."""
    span = F.when(start <= complete, F.sequence(start, complete)).otherwise(
        F.array().cast("array<date>"))
    return F.filter(span, lambda day: _works(day, off))


def business_dates(df: DataFrame, calendar: DataFrame, *, from_year: int,
                   start: str = "startDate", complete: str = "completeDate",
                   name: str = "B_dates") -> DataFrame:
    """Add the array of business dates of each row. Dates the calendar lacks are business dates."""
    flagged = df.withColumn("_nonwork", nonwork_flags(calendar, from_year))
    dates = dates_between(F.to_date(F.col(start)), F.to_date(F.col(complete)), F.col("_nonwork"))
    return flagged.withColumn(name, dates).drop("_nonwork")


def working_words(df: DataFrame, calendar: DataFrame, *, from_year: int,
                  keys: Sequence[str] = REPEAT_KEYS) -> DataFrame:
    """Bitmaps of the distinct business days of each group, see `daybits.group_words`; `lacking` has
    the days of the group that are missing within the calendar."""
    off = (F.col("isworkday") == 0) & (F.year("date") >= from_year)
    words = group_words(df, keys, "startDate", "completeDate", "subIntervalName")
    flagged = words.withColumn("_calendar", calendar_words(calendar, off))
    off_days, lacking = (
        word_at(F.col("_calendar")[name], F.col("_calendar")["first"], F.col("word"))
        for name in ("off", "lacking")
    )
    return flagged.select(
        *keys, "word", "first", "last", "named",
        F.col("bits").bitwiseAND(F.bitwise_not(off_days)).alias("bits"),
        F.col("bits").bitwiseAND(lacking).alias("lacking"),
    )


def group_dates(df: DataFrame, calendar: DataFrame, *, from_year: int,
                keys: Sequence[str] = REPEAT_KEYS) -> DataFrame:
    """Distinct business dates per group, sorted, as `B_dates`; groups without a valid span lack.

    A group collects one bitmap for 64 days, so its list is bounded by the calendar. Dates the
    calendar lacks are business dates.
    """
    words = working_words(df, calendar, from_year=from_year, keys=keys)
    found = words.where(F.col("first").isNotNull()).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("word", "bits", "first", "last"))).alias("_words"))
    dates = F.flatten(F.transform("_words", lambda w: F.filter(
        F.sequence(F.date_from_unix_date(w["first"]), F.date_from_unix_date(w["last"])),
        lambda day: F.getbit(w["bits"], F.unix_date(day).bitwiseAND(63)) == 1)))
    return found.select(*keys, dates.alias("B_dates"))


def rework_days(df: DataFrame, calendar: DataFrame, *, from_year: int,
                keys: Sequence[str] = REPEAT_KEYS, repeated: bool = False) -> DataFrame:
    """Distinct business days per group as column `days`, without listing the dates.

    The days are bits that are counted. As in `group_dates`, dates before and after the calendar are
    business dates; a date missing in between is an error. With `repeated`, only groups of several
    named rows are returned.
    """
    words = working_words(df, calendar, from_year=from_year, keys=keys)
    missing = F.concat(F.lit("the calendar lacks "), F.date_from_unix_date(
        lowest_day(F.col("lacking"), F.col("word"))).cast("string"))
    days = F.when(F.col("lacking") == 0, F.bit_count("bits")).otherwise(F.raise_error(missing).cast("int"))
    groups = words.groupBy(*keys).agg(
        F.sum(days).cast("int").alias("days"), F.sum("named").alias("_named"),
        F.max("first").alias("_last"))
    found = groups.where(F.col("_last").isNotNull())
    if repeated:
        found = found.where(F.col("_named") > 1)
    return found.select(*keys, "days")


def missing_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns in which a value is missing somewhere."""
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns)).first()
    return [c for c in columns if counts[c]]


def _first_rows(df: DataFrame, keys: Sequence[str], missing: Sequence[str]) -> DataFrame:
    """Per group the row count, the count of names and the first non-missing value per column.

    First means by start, completion and then all columns, so that the choice is the same on every
    run. Partial aggregation keeps one whole row per group and task, and one more for each column
    in `missing`.
    """
    payload = [c for c in df.columns if c not in keys]
    order = ["startDate", "completeDate"]
    order += [c for c in payload if c not in order]
    row = F.struct(*order)
    found = df.groupBy(*keys).agg(
        F.count("subIntervalName").alias("count"),
        F.count(F.lit(1)).alias("_rows"),
        F.min(row).alias("_first"),
        *(F.min(F.when(F.col(c).isNotNull(), row))[c].alias(f"_first_{c}") for c in missing),
    )
    return found.select(
        *keys, "count", "_rows",
        *(
            F.coalesce(f"_first.{c}", f"_first_{c}").alias(c) if c in missing
            else F.col(f"_first.{c}").alias(c)
            for c in payload
        ),
    )


def _single_rows(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame] | None:
    """The rows that are alone in their group, but for a few, and all others, told apart in the scan.

    Only the keys are counted and shuffled; a bitmap keeps those of several rows. None if they are few.
    """
    several = stage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select(
        *keys), "repeated-tasks")
    held = KeyFilter(several, *keys).held(df)
    return None if held is None else (df.where(~held), df.where(held))


def rework_merge(df: DataFrame, calendar: DataFrame, *, from_year: int,
                 keys: Sequence[str] = REPEAT_KEYS, nullable: Sequence[str] | None = None,
                 recompute_singles: bool = False, form: str = "dates") -> DataFrame:
    """One row per order and task: repeats are merged into their distinct business days.

    Tasks that occur once keep their interval unless `recompute_singles`. `form="dates"` adds the
    dates as `B_dates`; `form="counts"` only counts them. `nullable` must name the columns in which a
    value is missing somewhere; by default a pass over `df` finds them. `df` is read a few times more:
    pass a stored table or a chain without shuffles. Where only days are counted and singles keep their
    interval, rows that are alone in their group are neither sorted nor shuffled.
    """
    columns = df.columns
    payload = [c for c in columns if c not in keys]
    keyed = df.where(" and ".join(f"{k} is not null" for k in keys)).withColumns({
        "startDate": F.to_date("startDate"), "completeDate": F.to_date("completeDate"),
    })
    missing = missing_columns(keyed, payload) if nullable is None else list(nullable)
    split = _single_rows(keyed, keys) if form == "counts" and not recompute_singles else None
    if split:
        alone, rest = split
        merged = _merged(rest, calendar, from_year, keys, missing, recompute_singles, form)
        return alone.where(F.col("subIntervalName").isNotNull()).select(
            *columns, F.lit(1).cast("long").alias("count")).unionByName(merged)
    return _merged(keyed, calendar, from_year, keys, missing, recompute_singles, form)


def _merged(keyed: DataFrame, calendar: DataFrame, from_year: int, keys: Sequence[str],
            missing: Sequence[str], recompute_singles: bool, form: str) -> DataFrame:
    """`rework_merge` of rows with keys and dates."""
    columns = keyed.columns
    groups = _first_rows(keyed, keys, missing)
    groups = groups.where(F.col("count") >= 1)
    if form == "dates":
        found = group_dates(keyed, calendar, from_year=from_year, keys=keys)
        dates = F.coalesce("B_dates", F.array().cast("array<date>"))
        extra, days = [dates.alias("B_dates")], F.size(dates)
    else:
        found = rework_days(keyed, calendar, from_year=from_year, keys=keys,
                            repeated=not recompute_singles)
        extra, days = [], F.coalesce("days", F.lit(0))
    if not recompute_singles:
        days = F.when(F.col("count") > 1, days).otherwise(F.col(DAYS))
    merged = groups.join(found, list(keys), "left")

    result = merged.select(
        *(days.alias(DAYS) if c == DAYS else F.col(c) for c in columns), "count", "_rows", *extra)
    if "subIntervalName" not in missing:
        return result.drop("_rows")

    # A group with one named row may also hold rows without a name: those stay as they are.
    apart = stage(
        groups.where((F.col("count") == 1) & (F.col("_rows") > 1)).select(*keys), "mixed-tasks")
    rows = keyed.join(apart, list(keys), "left_semi").withColumn("count", F.lit(1).cast("long"))
    if form == "dates":
        rows = business_dates(rows, calendar, from_year=from_year)
    return result.where((F.col("count") > 1) | (F.col("_rows") == 1)).drop("_rows").unionByName(rows)
