"""Nearest measurement in time, several analytes in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohorta.functions.dates import diff_days


def lab_extract(labs: DataFrame, codes: Sequence[str], name: str) -> DataFrame:
    """One analyte as ``patientid, date_<name>, <name>_value``."""
    return labs.where(F.col("npu").isin(list(codes))).select(
        "patientid",
        F.to_date("date").alias(f"date_{name}"),
        F.col("value").alias(f"{name}_value"),
    )


def nearest_values(
    index: DataFrame,
    labs: DataFrame,
    analytes: Mapping[str, Sequence[str]],
    index_date: str = "date_diagnosis",
    window: tuple[int, int] = (-30, 30),
    key: str = "patientid",
    with_dates: bool = False,
) -> DataFrame:
    """Per index row and analyte the value nearest to the index date, null when none lies
    in the window.  Ties: the earlier date, then the smaller value.

    ``index`` has one row per subject.  One join and one aggregate serve all analytes.
    """
    wanted = sorted({c for codes in analytes.values() for c in codes})
    near = (
        labs.where(F.col("npu").isin(wanted) & F.col("value").isNotNull())
        .join(index.select(key, F.col(index_date).alias("_t0")), key)
        .where(F.col("date").between(F.date_add("_t0", window[0]), F.date_add("_t0", window[1])))
        .withColumn("_d", diff_days(F.col("_t0"), F.col("date")))
    )
    rank = F.struct(F.abs("_d"), F.col("date"), F.col("value"))
    picks = []
    for name, codes in analytes.items():
        mine = F.col("npu").isin(list(codes))
        picks.append(F.min_by("value", F.when(mine, rank)).alias(f"{name}_value"))
        if with_dates:
            picks.append(F.min_by("date", F.when(mine, rank)).alias(f"date_{name}"))
    return index.join(near.groupBy(key).agg(*picks), key, "left")


def own_or_nearest(df: DataFrame, pairs: Mapping[str, str]) -> DataFrame:
    """Register value where present, else the laboratory value (``{own: lab}``)."""
    return df.withColumns({own: F.coalesce(F.col(own), F.col(lab)) for own, lab in pairs.items()})
