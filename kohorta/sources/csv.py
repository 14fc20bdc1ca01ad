"""CSV in both conventions, and stage tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kohorta.functions.text import decimal_comma

_FRACTIONAL = (T.DoubleType, T.FloatType, T.DecimalType)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Comma-separated, decimal point, header line, ``NA`` for missing."""
    return spark.read.schema(schema).csv(path, header=True, nullValue="NA")


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).csv(path, header=True, nullValue="NA")


def read_csv2(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Semicolon-separated with decimal comma."""
    raw = T.StructType(
        [
            T.StructField(f.name, T.StringType() if isinstance(f.dataType, _FRACTIONAL) else f.dataType)
            for f in schema
        ]
    )
    df = spark.read.schema(raw).csv(path, header=True, sep=";", nullValue="NA")
    return df.select(
        *[
            decimal_comma(F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name)
            if isinstance(f.dataType, _FRACTIONAL)
            else F.col(f"`{f.name}`")
            for f in schema
        ]
    )


def write_csv2(df: DataFrame, path: str, mode: str = "error") -> None:
    """Semicolon-separated; fractional columns with a decimal comma."""
    text = df.select(
        *[
            F.regexp_replace(F.col(f"`{f.name}`").cast("string"), r"\.", ",").alias(f.name)
            if isinstance(f.dataType, _FRACTIONAL)
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )
    text.write.mode(mode).csv(path, header=True, sep=";", nullValue="NA")


class Stages:
    """Named stage tables below one folder; a later run can start from them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def save(self, name: str, df: DataFrame) -> DataFrame:
        """Write the stage and hand back the written table."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.load(name, df.schema)

    def save_by_year(self, name: str, df: DataFrame, date: str) -> DataFrame:
        """Events in one folder per year, so that a study window prunes folders."""
        dated = df.withColumn("year", F.year(date))
        dated.repartition("year", F.pmod(F.xxhash64(*df.columns), F.lit(64))).write.mode("overwrite").partitionBy(
            "year"
        ).parquet(self.path(name))
        return self.load(name, T.StructType([*df.schema.fields, T.StructField("year", T.IntegerType())]))

    def save_bucketed(self, name: str, df: DataFrame, key: str, buckets: int) -> DataFrame:
        """Write in sorted buckets of ``key``: joins and aggregates on it between tables
        with the same number of buckets need no exchange.  The bucketing is known to this
        session; another one reads the files as a plain stage."""
        table = f"stage_{name}_{uuid.uuid4().hex}"
        (
            df.repartition(buckets, key)
            .write.mode("overwrite")
            .option("path", self.path(name))
            .bucketBy(buckets, key)
            .sortBy(key)
            .saveAsTable(table)
        )
        return self.spark.table(table)

    def load(self, name: str, schema: T.StructType | None = None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(self.path(name))
