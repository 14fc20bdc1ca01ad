"""Day and year arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365.25


def diff_days(start: Column, end: Column) -> Column:
    """Whole days from ``start`` to ``end`` (both dates)."""
    return F.date_diff(end, start)


def diff_days_exact(start: Column, end: Column) -> Column:
    """Fractional days between two date-times, free of the session's time zone."""
    gap = end - start
    part = lambda unit: F.extract(F.lit(unit), gap).cast("long")
    micros = (F.extract(F.lit("SECOND"), gap) * 1_000_000).cast("long")
    whole = ((part("DAY") * 24 + part("HOUR")) * 60 + part("MINUTE")) * 60_000_000 + micros
    return whole / F.lit(86_400_000_000.0)


def diff_years(start: Column, end: Column, days_per_year: float = DAYS_PER_YEAR) -> Column:
    return diff_days(start, end) / F.lit(float(days_per_year))


def in_lookback(days: Column, window_days: float = DAYS_PER_YEAR, gap_days: int = 0) -> Column:
    """``days`` (event minus index) inside ``(-window_days, -gap_days]``."""
    return (days <= F.lit(-gap_days)) & (days > F.lit(-float(window_days)))


def lookback_bounds(index: Column, window_days: float = DAYS_PER_YEAR, gap_days: int = 0):
    """First and last event date of the window, so that a join can range-filter on dates."""
    earliest = -int(window_days) if float(window_days) != int(window_days) else 1 - int(window_days)
    return F.date_add(index, earliest), F.date_add(index, -gap_days)


def rate_per_year(count: Column, years: Column) -> Column:
    """Events per year; null where count or time is unknown or the time is zero."""
    return F.try_divide(count.cast("double"), years)
