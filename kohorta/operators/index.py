"""Index events: first qualifying diagnosis, entity labels, the index table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohorta.functions.dates import diff_years
from kohorta.operators.keyed import first_per_key
from kohorta.sources.codes import code_list, small_frame


def with_code(df: DataFrame, code: str, wanted: Sequence[str], match: str = "exact") -> DataFrame:
    """Rows whose code is listed exactly, or starts with / contains a listed text."""
    col = F.col(code)
    if match == "exact":
        return df.where(col.isin(list(wanted)))
    test = Column.startswith if match == "prefix" else Column.contains
    cond = F.lit(False)
    for text in wanted:
        cond = cond | test(col, text)
    return df.where(cond)


def first_diagnosis(
    dx: DataFrame,
    codes: Sequence[str],
    key: str = "patientid",
    date: str = "date_diagnosis",
    code: str = "diagnosis",
    tie: Sequence[str] = (),
    match: str = "exact",
) -> DataFrame:
    """Earliest qualifying diagnosis per subject; ties by code, then by ``tie``."""
    return first_per_key(with_code(dx, code, codes, match), [key], [date, code, *tie])


def label_by_codes(
    df: DataFrame, lists: Mapping[str, Sequence[str]], code: str = "diagnosis", name: str = "Disease"
) -> DataFrame:
    """Entity label of a code; on overlapping lists the last list wins, others stay null."""
    spark = df.sparkSession
    labels = (
        code_list(spark, lists)
        .groupBy("code")
        .agg(F.max_by("list_name", "rung").alias(name))
        .withColumnRenamed("code", "_code")
    )
    return df.join(labels, df[code] == F.col("_code"), "left").drop("_code")


def prefix_groups(
    events: DataFrame, code: str, prefixes: Sequence[Sequence], names: Sequence[str]
) -> DataFrame:
    """Join events to a table keyed by code prefix (first name is the prefix).

    Each code is expanded to its leading substrings of the lengths in the table, so
    the match is a hash join on equality and not a test of every row against every
    prefix.
    """
    lengths = sorted({len(row[0]) for row in prefixes})
    table = small_frame(events.sparkSession, prefixes, names)
    heads = F.array_distinct(F.array(*[F.left(F.col(code), F.lit(n)) for n in lengths]))
    return events.withColumn(names[0], F.explode(heads)).join(table, names[0])


def index_table(
    first: DataFrame,
    lists: Mapping[str, Sequence[str]],
    subjects: DataFrame,
    prognosis: DataFrame | None = None,
    key: str = "patientid",
) -> DataFrame:
    """One row per subject: entity, follow-up time from diagnosis, age, prognostic group.

    ``subjects`` brings ``date_birth`` and ``date_death_fu``.  Subjects whose follow-up
    ends before the diagnosis leave.
    """
    out = (
        label_by_codes(first, lists)
        .join(subjects, key)
        .withColumn("time_dx_death", diff_years(F.col("date_diagnosis"), F.col("date_death_fu")))
        .where(F.col("time_dx_death") >= 0)
    )
    if prognosis is not None:
        out = out.join(prognosis, [key, "Disease"], "left")
    return out.withColumn("Age", diff_years(F.col("date_birth"), F.col("date_diagnosis")))
