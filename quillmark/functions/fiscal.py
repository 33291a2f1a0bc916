"""Fiscal calendar: which year and quarter a period belongs to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days that a period may end after the nominal year end and still belong to it.
TOLERANCE = 21
#: Spans in days, both ends included.
YEAR_SPAN, QUARTER_SPAN = (300, 400), (80, 100)


def year_end(year: Column, month: Column, day: Column) -> Column:
    """Nominal year end in a calendar year; what that month doesn't have (29
    February) is its 28th."""
    last = F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))
    return F.make_date(year, month, F.when(day > last, 28).otherwise(day))


def fiscal_year(end: Column, month: Column, day: Column) -> Column:
    """Year of the first fiscal year end on or after the period end, give or
    take the tolerance; years are named by the calendar year they end in."""
    y = F.year(end)
    near = lambda shift: end <= F.date_add(year_end(y + shift, month, day), TOLERANCE)
    return F.when(near(0), y).otherwise(y + 1)


def fiscal_quarter(end: Column, month: Column, day: Column) -> Column:
    """Quarters since the year before ended, rounded half to even, 1 to 4."""
    days = F.datediff(end, year_end(fiscal_year(end, month, day) - 1, month, day))
    return F.least(F.greatest(F.bround(days / F.lit(91.25)).cast("int"), F.lit(1)), F.lit(4))


def span_days(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def duration_period(start: Column, end: Column, month: Column, day: Column) -> Column:
    """``FY``, ``Q1`` to ``Q3``, or null for what is left out: year-to-date
    spans, periods without a start, and a fourth quarter of its own."""
    d = span_days(start, end)
    q = fiscal_quarter(end, month, day)
    return F.when(d.between(*YEAR_SPAN), "FY").when(d.between(*QUARTER_SPAN) & (q < 4), F.concat(F.lit("Q"), q.cast("string")))


def instant_period(end: Column, month: Column, day: Column) -> Column:
    """``FY`` at the year end, else the quarter."""
    q = fiscal_quarter(end, month, day)
    return F.when(q == 4, "FY").when(q.isNotNull(), F.concat(F.lit("Q"), q.cast("string")))


def within_hours(ts: Column, zone: str = "America/New_York", first: int = 6, last: int = 22) -> Column:
    """Whether an instant lies on a working day from hour ``first`` to before
    ``last`` of a zone, daylight saving included."""
    local = F.from_utc_timestamp(ts, zone)
    return (F.weekday(local) < 5) & (F.hour(local) >= first) & (F.hour(local) < last)
