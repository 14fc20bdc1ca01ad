"""Missing-value rules of the statistical source language, as Spark columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def if_na(cond: Column, yes, no) -> Column:
    """``cond ? yes : no`` where an unknown condition gives an unknown result."""
    return F.when(cond.isNull(), F.lit(None)).when(cond, _col(yes)).otherwise(_col(no))


def ladder(rungs: Iterable[tuple[Column, object]], start=None) -> Column:
    """Successive overwrites: each rung replaces the value so far where it holds.

    The last true rung wins, and a rung whose condition is unknown wipes the value.
    """
    value = _col(start)
    for cond, new in rungs:
        value = if_na(cond, new, value)
    return value


def is_in(col: Column, values: Iterable) -> Column:
    """Membership that is never unknown: a null is simply not a member."""
    return F.coalesce(col.isin(list(values)), F.lit(False))


def not_in(col: Column, values: Iterable) -> Column:
    """Negated membership; keeps nulls."""
    return ~is_in(col, values)


def zero_if_null(col: Column) -> Column:
    return F.coalesce(col, F.lit(0))


def later_of(a: Column, b: Column) -> Column:
    """The later of two dates; unknown when either is (``greatest`` would skip nulls)."""
    return if_na(a < b, b, a)


def void_before(date: Column, start: Column) -> Column:
    """``date``, or null where it lies before ``start`` (or the comparison is unknown)."""
    return if_na(date < start, None, date)


def presence(col: Column, no="No", yes="Yes") -> Column:
    """Two-level label from presence of a value."""
    return F.when(col.isNull(), F.lit(no)).otherwise(F.lit(yes))


def flag(col: Column) -> Column:
    """1 where a value is present, else 0."""
    return col.isNotNull().cast("int")


def max_strict(col: Column) -> Column:
    """Aggregate maximum that is null as soon as one value is null."""
    return F.when(F.count(F.when(col.isNull(), 1)) == 0, F.max(col))


def sum_strict(col: Column) -> Column:
    """Aggregate sum that is null as soon as one value is null."""
    return F.when(F.count(F.when(col.isNull(), 1)) == 0, F.sum(col))


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)
