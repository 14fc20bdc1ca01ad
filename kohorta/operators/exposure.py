"""Dispensings and drug exposure before the index date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohorta.functions.bins import DRUG_COUNT_CUTS, at_least, cut
from kohorta.functions.dates import DAYS_PER_YEAR, lookback_bounds
from kohorta.functions.nulls import not_in
from kohorta.functions.text import VOID_CODES, clean_code
from kohorta.operators.keyed import keep_cohort


def harmonise_dispensings(rx: DataFrame, code: str = "atc") -> DataFrame:
    """Clean codes and drop the void ones (a missing code stays)."""
    cleaned = rx.withColumn(code, clean_code(F.col(code)))
    return cleaned.where(not_in(F.col(code), VOID_CODES))


def last_date(events: DataFrame, date: str = "date") -> Column:
    """Latest event date as a scalar subquery."""
    return events.agg(F.max(date)).scalar()


def study_period(index: DataFrame, start=None, end: Column | None = None, date: str = "date_diagnosis") -> DataFrame:
    """Index rows inside the study period (both ends included)."""
    out = index if start is None else index.where(F.col(date) >= F.lit(start).cast("date"))
    return out if end is None else out.where(F.col(date) <= end)


def lookback(
    index: DataFrame,
    events: DataFrame,
    index_date: str = "date_diagnosis",
    window_days: float = DAYS_PER_YEAR,
    gap_days: int = 0,
    key: str = "patientid",
) -> DataFrame:
    """Events in ``(-window, -gap]`` days of the index date, with ``days`` from it."""
    lo, hi = lookback_bounds(F.col("_t0"), window_days, gap_days)
    return (
        events.join(index.select(key, F.col(index_date).alias("_t0")), key)
        .where((F.col("date") >= lo) & (F.col("date") <= hi))
        .withColumn("days", F.date_diff("date", "_t0"))
        .drop("_t0")
    )


def history(
    index: DataFrame, events: DataFrame, index_date: str = "date_diagnosis", key: str = "patientid", after: str | None = None
) -> DataFrame:
    """Events up to and including the index date (subjects without any drop out); ``after`` leaves out those up to a day,
    such as a register's dummy date."""
    events = events if after is None else events.where(F.col("date") > F.lit(after).cast("date"))
    return (
        events.join(index.select(key, F.col(index_date).alias("_t0")), key)
        .where(F.col("date") <= F.col("_t0"))
        .drop("_t0")
    )


def polypharmacy(
    index: DataFrame,
    rx: DataFrame,
    window_days: float = DAYS_PER_YEAR,
    gap_days: int = 0,
    threshold: int = 5,
    key: str = "patientid",
    index_date: str = "date_diagnosis",
) -> DataFrame:
    """Index rows plus ``n_atc`` (distinct drugs before the index, 0 when none) and the
    two-level label.  The distinct count aggregates per (subject, code) first, so no task
    holds all rows of a subject."""
    per_key = (
        lookback(index, rx, index_date, window_days, gap_days, key)
        .groupBy(key)
        .agg((F.count_distinct("atc") + F.max(F.col("atc").isNull().cast("int"))).alias("n_atc"))
    )
    out = keep_cohort(index, per_key, key, zeros=["n_atc"])
    return out.withColumn("polypharmacy", at_least(F.col("n_atc"), threshold))


def with_drug_bins(df: DataFrame, column: str = "n_atc", name: str = "atc_bin") -> DataFrame:
    return df.withColumn(name, cut(F.col(column), *DRUG_COUNT_CUTS))


def class_exposure(events: DataFrame, width: int = 3, key: str = "patientid") -> DataFrame:
    """Distinct drug classes per subject (leading characters of the code), with the
    number of dispensings."""
    return (
        events.withColumn("atc3", F.left(F.col("atc"), F.lit(width)))
        .groupBy(key, "atc3")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def class_wide(cohort: DataFrame, exposure: DataFrame, classes: Sequence[str], key: str = "patientid") -> DataFrame:
    """Cohort rows with one No/Yes column per class."""
    wide = (
        exposure.where(F.col("atc3").isin(list(classes)))
        .groupBy(key)
        .agg(*[F.max(F.when(F.col("atc3") == c, F.lit("Yes"))).alias(c) for c in classes])
    )
    out = cohort.join(wide, key, "left")
    return out.fillna("No", subset=list(classes))


def class_prevalence(exposure: DataFrame, n_cohort: Column, key: str = "patientid") -> DataFrame:
    """Subjects per class and their share of the cohort."""
    return (
        exposure.groupBy("atc3")
        .agg(F.count_distinct(key).alias("n_patients"))
        .withColumn("freq", F.col("n_patients") / n_cohort)
    )


def yes_counts(wide: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Number of "Yes" per indicator column, long."""
    counts = wide.agg(*[F.count(F.when(F.col(c) == "Yes", 1)).alias(c) for c in classes])
    return counts.unpivot([], list(classes), "atc3", "n")
