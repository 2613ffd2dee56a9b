"""Date parsing and the US federal business calendar as expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions.columns import any_of, col

# Federal holidays. (month, day) moves to the nearest weekday;
# (month, weekday, nth) counts weekdays with Sunday = 1, -1 meaning the last.
# The third field is the first year observed.
FIXED_HOLIDAYS = ((1, 1, 0), (6, 19, 2021), (7, 4, 0), (11, 11, 0), (12, 25, 0))
FLOATING_HOLIDAYS = ((1, 2, 3, 1986), (2, 2, 3, 0), (5, 2, -1, 0), (9, 2, 1, 0), (10, 2, 2, 0), (11, 5, 4, 0))


def parse_date(c: str | Column) -> Column:
    """UTC calendar date of a timestamp string, null when it does not parse."""
    return F.to_date(F.try_to_timestamp(col(c)))


def _on(day: Column, month: int, dom: int, first_year: int) -> Column:
    return (F.month(day) == month) & (F.dayofmonth(day) == dom) & (F.year(day) >= first_year)


def is_holiday(day: Column) -> Column:
    dow = F.dayofweek(day)
    rules = []
    for month, dom, first in FIXED_HOLIDAYS:
        friday_before = (dow == 6) & _on(F.date_add(day, 1), month, dom, first)
        monday_after = (dow == 2) & _on(F.date_sub(day, 1), month, dom, first)
        rules.append(_on(day, month, dom, first) | friday_before | monday_after)
    for month, weekday, nth, first in FLOATING_HOLIDAYS:
        if nth > 0:
            in_week = F.ceil(F.dayofmonth(day) / 7) == nth
        else:
            in_week = F.month(F.date_add(day, 7)) != month
        rules.append((F.month(day) == month) & (dow == weekday) & in_week & (F.year(day) >= first))
    return any_of(rules)


def is_open(day: Column) -> Column:
    return ~F.dayofweek(day).isin(1, 7) & ~is_holiday(day)


def next_open_day(c: str | Column) -> Column:
    """The date itself if it is a business day, else the next one.

    Row by row, with no calendar table: a closed stretch is never longer than
    a week, so eight days always hold an open one.
    """
    day = col(c)
    ahead = F.filter(F.sequence(day, F.date_add(day, 7)), is_open)
    return F.when(is_open(day), day).otherwise(F.get(ahead, F.lit(0)))
