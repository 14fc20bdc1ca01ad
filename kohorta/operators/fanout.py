"""Several looks at one event table in one pass: each row is tagged by the looks it counts for, and one aggregate per
subject holds a conditional state for each.

Where exposures, nearest measurements and coded history come from the same stored rows, a plan per look reads, joins
and shuffles those rows once per look.  Here they are joined to the index once, rows that no look wants are dropped
before anything else, and the states combine on the map side, so no task gathers the rows of one subject.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohorta.functions.dates import diff_days

INDEX_DATE = "_t0"
Look = tuple[Column, Callable[[Column], Column]]


def distinct_look(counts: Column, value: Column, listed: Column | None = None) -> Look:
    """Distinct values; a missing value counts as one more.  ``listed`` is a condition on attached columns."""

    def state(tag: Column) -> Column:
        tag = tag if listed is None else tag & listed
        missing = F.coalesce(F.max(F.when(tag & value.isNull(), 1)), F.lit(0))
        return F.count_distinct(F.when(tag, value)) + missing

    return counts, state


def nearest_look(counts: Column, value: Column, date: Column) -> Look:
    """Value nearest to the index date; ties: the earlier date, then the smaller value."""

    def state(tag: Column) -> Column:
        rank = F.struct(F.abs(diff_days(F.col(INDEX_DATE), date)).alias("d"), date.alias("at"), value.alias("v"))
        return F.min_by(value, F.when(tag & value.isNotNull(), rank))

    return counts, state


def mask_look(counts: Column, mask: Column) -> Look:
    """Union of the rows' bit masks."""
    return counts, lambda tag: F.bit_or(F.when(tag, mask))


def fan_out(
    index: DataFrame,
    events: DataFrame,
    looks: Mapping[str, Look],
    attach: Callable[[DataFrame], DataFrame] | None = None,
    index_date: str = "date_diagnosis",
    key: str = "patientid",
) -> DataFrame:
    """One row per subject with a wanted event, a column per look; ``index`` has one row per subject.

    A look's condition reads columns of ``events`` and ``INDEX_DATE``; a condition that is unknown does not count.
    ``attach`` adds columns that only states read (a join to a further table), after rows without any look are gone.
    It may drop no rows.
    """
    tags = {name: F.coalesce(counts, F.lit(False)) for name, (counts, _) in looks.items()}
    dated = events.join(index.select(key, F.col(index_date).alias(INDEX_DATE)), key)
    wanted = dated.where(reduce(lambda a, b: a | b, tags.values()))
    rows = wanted if attach is None else attach(wanted)
    return rows.groupBy(key).agg(*[state(tags[name]).alias(name) for name, (_, state) in looks.items()])
