"""Dates written in text, and the backwards calendar of search ranges."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names accepted in article dates.
MONTH_NAMES = [
    "January", "Jan",
    "February", "Feb",
    "March", "Mar",
    "April", "Apr",
    "May",
    "June", "Jun",
    "July", "Jul",
    "August", "Aug",
    "September", "Sep", "Sept",
    "October", "Oct",
    "November", "Nov",
    "December", "Dec",
]

_MONTHS = "|".join(MONTH_NAMES)
DATE_PATTERN = rf"({_MONTHS}) \d+,? \d+"
# The look-ahead rejects most positions before the names are tried; it changes no match.
_FIND_DATE = rf"(?=[ADFJMNOSadfjmnos][A-Za-z]{{2,8}} \d)(?i:{DATE_PATTERN})"
_MONTH_STARTS = "janfebmaraprmayjunjulaugsepoctnovdec"


def first_date_text(col: Column) -> Column:
    """The first 'Month day, year' of the text, '' when there is none."""
    return F.regexp_extract(col, _FIND_DATE, 0)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _full_year(year: Column, reference_year: Column) -> Column:
    """Two-digit years fall within 50 years of the reference year."""

    def nearest(guess: Column) -> Column:
        return (
            F.when(guess >= reference_year + 50, guess - 100)
            .when(guess < reference_year - 50, guess + 100)
            .otherwise(guess)
        )

    def widened(y: Column) -> Column:
        return F.when(y < 100, let(y + F.floor(reference_year / 100) * 100, nearest)).otherwise(y).cast("int")

    return let(year, widened)


def parse_date(col: Column, reference_year: int | None = None) -> Column:
    """First date of the text as DATE; NULL when absent or impossible.

    A first number above 31 is read as the year ("March 2017 5"). The text is searched
    once; everything else works on the few characters found.
    """
    ref = F.lit(reference_year) if reference_year else F.year(F.current_date())

    def from_parts(parts: Column) -> Column:
        month = (F.instr(F.lit(_MONTH_STARTS), F.lower(F.substring(F.get(parts, F.lit(0)), 1, 3))) + 2) / 3
        first, second = (F.get(parts, F.lit(i)).try_cast("int") for i in (1, 2))
        numbers = F.struct(
            F.when(first > 31, second).otherwise(first).alias("day"),
            _full_year(F.when(first > 31, first).otherwise(second), ref).alias("year"),
        )

        def as_date(n: Column) -> Column:
            text = F.concat_ws(
                "-", F.lpad(n["year"].cast("string"), 4, "0"), month.cast("int").cast("string"), n["day"].cast("string")
            )
            usable = n["day"].between(1, 31) & n["year"].between(1, 9999)
            return F.when(usable, F.try_to_date(text, "yyyy-M-d"))

        return let(numbers, as_date)

    return let(F.split(first_date_text(col), ",? "), lambda p: F.when(F.size(p) == 3, from_parts(p)))


def is_date_line(col: Column) -> Column:
    """The whole line is one date."""
    return col.rlike(rf"(?i)\A(?:{DATE_PATTERN})\z")


def blank_dates(col: Column) -> Column:
    return F.regexp_replace(col, _FIND_DATE, " ")


class Offset(NamedTuple):
    """Steps backwards that do not build on each other: ``back(day, k)`` is ``k`` steps before ``day``.

    All steps but the first are at least ``shortest`` days long, and the first at least one.
    """

    back: Callable[[Column, Column], Column]
    shortest: int


def days(n: int = 1) -> Offset:
    return Offset(lambda day, k: F.date_sub(day, k * n), n)


def weeks(n: int = 1) -> Offset:
    return days(7 * n)


def business_days(n: int = 1) -> Offset:
    """Mondays to Fridays; a day of the weekend counts as the Monday after it."""

    def back(day: Column, k: Column) -> Column:
        w = F.weekday(day)
        whole, rest = F.floor(k * n / 5).cast("int"), k * n % 5
        monday = F.when(w > 4, 7 - w).otherwise(0)
        weekend = F.when(rest > F.when(w > 4, 0).otherwise(w), 2).otherwise(0)
        return F.date_sub(day, whole * 7 + rest + weekend - monday)

    return Offset(back, n)


def month_ends(n: int = 1) -> Offset:
    return Offset(lambda day, k: F.last_day(F.add_months(F.trunc(day, "month"), k * -n)), 28 * n)


def quarter_ends(n: int = 1) -> Offset:
    return Offset(lambda day, k: F.last_day(F.add_months(F.trunc(day, "quarter"), k * (-3 * n) + 2)), 90 * n)


def _offset_ranges(bounds: DataFrame, first: Column, last: Column, offset: Offset) -> DataFrame:
    """``bounds`` with ``range_from`` and ``range_to``, a row per step down to the one that reaches ``first``; at least one.

    Steps are rows before they are days, so every day is a plain expression of its row.
    """
    most = F.greatest(F.floor(F.date_diff(last, first) / offset.shortest), F.lit(0)) + 2
    numbered = bounds.withColumn("_step", F.explode(F.sequence(F.lit(1), most.cast("int"))))
    k = F.col("_step")
    reached = F.when(k == 1, last).otherwise(offset.back(last, k - 1))
    return numbered.filter((k == 1) | (offset.back(last, k - 1) > first)).select(
        *bounds.columns, offset.back(last, k).alias("range_from"), F.date_sub(reached, 1).alias("range_to")
    )


def _month_steps(first: Column, last: Column, months: int) -> Column:
    """``last`` and the days of its steps down to the one that reaches ``first``, one after the other, so a clipped month end stays clipped."""
    # An upper bound on the number of steps; surplus steps are cut off below.
    span = F.greatest(F.ceil(F.months_between(last, first) / months), F.lit(0)) + 2
    steps = F.aggregate(
        F.sequence(F.lit(1), span.cast("int")),
        F.array(last),
        lambda acc, _: F.when(F.element_at(acc, -1) <= first, acc).otherwise(
            F.array_append(acc, F.add_months(F.element_at(acc, -1), -months))
        ),
    )
    # when end <= start the first step is still taken once
    return F.when(F.size(steps) < 2, F.array(last, F.add_months(last, -months))).otherwise(steps)


def _month_ranges(bounds: DataFrame, first: Column, last: Column, months: int) -> DataFrame:
    pairs = F.transform(
        F.sequence(F.lit(2), F.size("_steps")),
        lambda i: F.struct(
            F.element_at("_steps", i).alias("range_from"),
            F.date_sub(F.element_at("_steps", i - 1), 1).alias("range_to"),
        ),
    )
    return (
        bounds.withColumn("_steps", _month_steps(first, last, months))
        .withColumn("_pair", F.explode(pairs))
        .select(*bounds.columns, "_pair.range_from", "_pair.range_to")
    )


def search_ranges(
    bounds: DataFrame, start: str, end: str, months: int = 1, hard_start: bool = False, offset: Offset | None = None
) -> DataFrame:
    """Explode each row's [start, end) into ranges going backwards from ``end``.

    Steps are ``months`` long unless an ``offset`` is given. The last range may begin before
    ``start`` unless ``hard_start``. Rows without a start or an end give no range. Adds
    ``range_from``, ``range_to`` and ``search_range``.
    """
    if (offset.shortest if offset else months) < 1:
        raise ValueError("steps go backwards by at least one")
    first, last = F.col(start), F.col(end)
    known = bounds.filter(first.isNotNull() & last.isNotNull())
    out = _offset_ranges(known, first, last, offset) if offset else _month_ranges(known, first, last, months)
    if hard_start:
        out = out.withColumn("range_from", F.greatest("range_from", first))
    label = F.concat(F.col("range_from").cast("string"), F.lit(" to "), F.col("range_to").cast("string"))
    return out.withColumn("search_range", label)
