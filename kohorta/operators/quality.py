"""Data-quality checks: each gives one row ``check, ok, n_bad``."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohorta.operators.keyed import union_all


def _row(name: str, bad: DataFrame) -> DataFrame:
    """``bad`` is one row with the number of violations in ``n_bad``."""
    n = F.coalesce(F.col("n_bad"), F.lit(0)).cast("long")
    return bad.select(F.lit(name).alias("check"), (n == 0).alias("ok"), n.alias("n_bad"))


def expect_values(df: DataFrame, column: str, allowed: Iterable, name: str) -> DataFrame:
    """Only listed values (a missing one is a violation)."""
    good = F.coalesce(F.col(column).isin(list(allowed)), F.lit(False))
    return _row(name, df.agg(F.count(F.when(~good, 1)).alias("n_bad")))


def expect_unique(df: DataFrame, key: str, name: str) -> DataFrame:
    """One row per key."""
    return _row(name, df.agg((F.count(F.lit(1)) - F.count_distinct(key)).alias("n_bad")))


def expect_same_ids(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """The same set of keys on both sides, in one pass over their union."""
    both = left.select(key, F.lit(1).alias("_side")).unionByName(right.select(key, F.lit(2).alias("_side")))
    sides = both.groupBy(key).agg(F.count_distinct("_side").alias("_sides"))
    return _row(name, sides.agg(F.count(F.when(F.col("_sides") < 2, 1)).alias("n_bad")))


def expect_all_true(df: DataFrame, cond: Column, name: str) -> DataFrame:
    """The condition holds on every row (unknown is a violation)."""
    return _row(name, df.agg(F.count(F.when(~F.coalesce(cond, F.lit(False)), 1)).alias("n_bad")))


def expect_none(df: DataFrame, column: str, name: str) -> DataFrame:
    """Violations counted per row, in ``column``, add up to none."""
    return _row(name, df.agg(F.sum(column).alias("n_bad")))


def expect_equal(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Two one-row, one-column numbers agree."""
    a, b = F.col(f"`{left.columns[0]}`"), right.scalar()
    return _row(name, left.select(F.abs(a - b).alias("n_bad")))


def report(checks: Iterable[DataFrame]) -> DataFrame:
    return union_all(list(checks))
