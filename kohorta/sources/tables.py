"""Register scans: whole, restricted to a cohort, restricted to codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Parquet scan; name the columns wanted so that only they are read."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def load_for_cohort(table: DataFrame, ids: DataFrame, key: str = "patientid") -> DataFrame:
    """Rows of the given subjects.

    No broadcast hint: Spark broadcasts the ids when their measured size is under
    the session's threshold and otherwise shuffles, with a runtime filter.
    """
    return table.join(ids.select(key), key, "left_semi")


def load_for_codes(
    table: DataFrame, codes: Sequence[str], column: str, pieces: Sequence[tuple[str, int, int]] = ()
) -> DataFrame:
    """Rows whose code is listed.

    The filter of a stored code column reaches the scan.  Where a view puts the code together from stored columns of fixed
    width, ``pieces`` names them (column, start, length): what the listed codes have there is filtered in the scan, the
    whole code behind it.
    """
    wanted = sorted(set(codes))
    for name, start, length in pieces:
        table = table.where(F.col(name).isin(sorted({c[start : start + length] for c in wanted})))
    return table.where(F.col(column).isin(wanted))


def store_by_code(table: DataFrame, path: str, column: str) -> DataFrame:
    """Write a register for loads by code and read it back.

    Files hold ranges of codes and are sorted by code, so row groups are skipped by their bounds, and by a Bloom filter of
    the code where the bounds are wide.  A code that holds many rows goes on over several files.
    """
    ranged = table.repartitionByRange(F.col(column), F.xxhash64(*table.columns)).sortWithinPartitions(column)
    ranged.write.option(f"parquet.bloom.filter.enabled#{column}", "true").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def stack_sources(parts: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """Union of like-shaped tables, each row tagged with its source."""
    frames = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out
