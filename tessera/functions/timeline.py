"""Years without a year zero: order, labels, ranges and names over time.

A year is a signed whole number, negative before Christ; 0 doesn't exist.
Arithmetic goes through an index in which the years are consecutive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The span of undated things.
UNDATED = (-4004, 100)
_DASH = " – "


class BadWindow(ValueError):
    """A range with a year zero or its ends the wrong way round."""


def check_window(first: int, last: int) -> tuple[int, int]:
    if first == 0 or last == 0 or first > last:
        raise BadWindow(f"bad_window: {first}..{last}")
    return first, last


def year_index(y: Column) -> Column:
    return F.when(y > 0, y - 1).otherwise(y)


def index_year(i: Column) -> Column:
    return F.when(i >= 0, i + 1).otherwise(i)


def next_year(y: Column) -> Column:
    return F.when(y == -1, F.lit(1)).otherwise(y + 1)


def add_years(y: Column, n: Column) -> Column:
    return index_year(year_index(y) + n)


def valid_range(first: Column, last: Column) -> Column:
    return (first != 0) & (last != 0) & (first <= last)


def intersects(a_first: Column, a_last: Column, b_first: Column, b_last: Column) -> Column:
    """Both ends count."""
    return (a_first <= b_last) & (b_first <= a_last)


def contains_year(first: Column, last: Column, y: Column) -> Column:
    return y.between(first, last)


def midpoint(first: Column, last: Column) -> Column:
    """The middle year; of two the earlier."""
    return index_year(F.floor((year_index(first) + year_index(last)) / 2).cast("int"))


def year_label(y: Column) -> Column:
    return F.when(y < 0, F.concat((-y).cast("string"), F.lit(" BC"))).otherwise(F.concat(F.lit("AD "), y.cast("string")))


def range_label(first: Column, last: Column) -> Column:
    """An era that both ends share is named once; a single year is its own label."""
    return (
        F.when(first == last, year_label(first))
        .when((first < 0) & (last < 0), F.concat((-first).cast("string"), F.lit(_DASH), year_label(last)))
        .when((first > 0) & (last > 0), F.concat(year_label(first), F.lit(_DASH), last.cast("string")))
        .otherwise(F.concat(year_label(first), F.lit(_DASH), year_label(last)))
    )


def claim_label(first: Column, last: Column, note: Column) -> Column:
    """A claim with a note is approximate."""
    return F.when(note.isNotNull(), F.concat(F.lit("c. "), range_label(first, last))).otherwise(range_label(first, last))


def existence(established: Column, destroyed: Column, first_name: Column, last_name: Column) -> tuple[Column, Column]:
    """Bounds of a place: a claimed bound is widened by the names' years, an absent one stays absent."""
    first = F.when(established.isNotNull(), F.least(established, first_name))
    last = F.when(destroyed.isNotNull(), F.greatest(destroyed, last_name))
    return first, last


def gated(first: Column, last: Column, window_first: Column, window_last: Column) -> Column:
    """Is the window wholly outside the bounds?  An absent bound never gates."""
    return F.coalesce(window_last < first, F.lit(False)) | F.coalesce(window_first > last, F.lit(False))


def parse_year(text: Column) -> Column:
    """``-4003`` (astronomical), ``33-04-01``, ``1446 BC`` or blank; anything else is null."""
    t = F.trim(text)
    before = F.regexp_extract(t, r"^(\d+)\s*BC$", 1)
    signed = F.regexp_extract(t, r"^(-?\d+)(?:-\d{1,2}){0,2}$", 1).try_cast("int")
    return F.when(before != "", -before.try_cast("int")).when(signed <= 0, signed - 1).otherwise(signed)
