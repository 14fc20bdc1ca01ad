"""Per-subject operators that never gather one subject's rows in one task.

Top-1 and totals per subject are aggregates with map-side combine instead of
windows, so a subject with a large share of all rows costs no more than others.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nulls_last(cols: Sequence[str | Column]) -> Column:
    """Ascending sort key of several columns, nulls after all values."""
    parts = []
    for c in cols:
        col = F.col(c) if isinstance(c, str) else c
        parts += [col.isNull(), col]
    return F.struct(*[p.alias(f"o{i}") for i, p in enumerate(parts)])


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], latest: bool = False
) -> DataFrame:
    """One whole row per key: the first (or ``latest``) under a total order."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    if latest:
        key_cols = [F.col(c) if isinstance(c, str) else c for c in order]
        rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(key_cols)])
        pick = F.max_by(F.struct(*rest), rank)
    else:
        pick = F.min_by(F.struct(*rest), nulls_last(order))
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, "_row.*")


def keep_cohort(cohort: DataFrame, per_key: DataFrame, key: str, zeros: Sequence[str] = ()) -> DataFrame:
    """All cohort rows with the values of ``per_key`` (one row per key); named columns 0 when absent."""
    out = cohort.join(per_key, key, "left")
    return out.fillna(0, subset=list(zeros)) if zeros else out


def with_totals(df: DataFrame, keys: Sequence[str], **totals: Column) -> DataFrame:
    """Group totals on every row: aggregate, then join back."""
    sums = df.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()])
    return df.join(sums, list(keys))


def rows_and_subjects(df: DataFrame, key: str = "patientid", approx: float | None = None) -> DataFrame:
    """Row count and distinct subjects; ``approx`` is a relative error for a sketch instead."""
    subjects = F.approx_count_distinct(key, approx) if approx else F.count_distinct(key)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), subjects.alias("n_patients"))


def distinct_levels(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Distinct values per key; a missing value counts as one level."""
    has_null = F.max(F.col(value).isNull().cast("int"))
    return df.groupBy(*keys).agg((F.count_distinct(value) + has_null).alias(name))


def union_ids(frames: Sequence[DataFrame], key: str = "patientid") -> DataFrame:
    """Distinct ids of several tables."""
    return reduce(DataFrame.union, [f.select(key) for f in frames]).distinct()


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which a missing key matches a missing key."""
    marked = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(marked[f"_r_{k}"]) for k in keys]
    )
    return left.join(marked, cond, how).drop(*[f"_r_{k}" for k in keys])


def columns_like(df: DataFrame, *parts: str) -> list[str]:
    """Column names holding one of the substrings, in table order, case ignored."""
    wanted = [p.lower() for p in parts]
    return [c for c in df.columns if any(p in c.lower() for p in wanted)]
