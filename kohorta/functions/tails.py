"""p-values for small result tables (one row per test or model term)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normal_two_sided(z: float | None) -> float | None:
    if z is None or math.isnan(z):
        return None
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi_square_upper(x: float | None, df: int | None) -> float | None:
    """Upper tail by the two-step recursion in the degrees of freedom."""
    if x is None or df is None or math.isnan(x) or df < 1:
        return None
    if x <= 0:
        return 1.0
    if df % 2:
        tail, k = math.erfc(math.sqrt(x / 2.0)), 1
    else:
        tail, k = math.exp(-x / 2.0), 2
    while k < df:
        tail += math.exp((k / 2.0) * math.log(x / 2.0) - x / 2.0 - math.lgamma(k / 2.0 + 1.0))
        k += 2
    return min(1.0, tail)


def _apply(df: DataFrame, name: str, compute) -> DataFrame:
    schema = df.withColumn(name, F.lit(None).cast("double")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[name] = pd.Series([compute(r) for r in batch.to_dict("records")], dtype="float64")
            yield batch

    return df.mapInPandas(run, schema)


def _num(value):
    return None if value is None or value != value else value


def with_normal_p(df: DataFrame, z: str, name: str = "p") -> DataFrame:
    """Add the two-sided normal p-value of column ``z``."""
    return _apply(df, name, lambda r: normal_two_sided(_num(r[z])))


def with_chi_square_p(df: DataFrame, stat: str, dof: str, name: str = "p") -> DataFrame:
    """Add the upper chi-square tail of ``stat`` on ``dof`` degrees of freedom."""
    return _apply(
        df,
        name,
        lambda r: chi_square_upper(_num(r[stat]), None if _num(r[dof]) is None else int(r[dof])),
    )
