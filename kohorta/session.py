"""Session settings the operators count on, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime SQL settings.  A single subject may own a third of all event rows, so
# sort-merge joins on the subject key must be split by AQE even where the split
# costs another exchange behind the join.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


# Batches of whole texts that Python workers get are bounded by their bytes: a number of rows alone lets a batch, and
# each copy of it in the JVM and in Python, grow with the length of the texts.
TEXT_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def configure(spark: SparkSession, texts: bool = False) -> SparkSession:
    """Switch on the adaptive settings above, and with ``texts`` the bound on batches unless the cluster has its own;
    other size-related settings stay the cluster's."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    if texts:
        _bound_batches(spark)
    return spark


def _bound_batches(spark: SparkSession) -> list[str]:
    """Set what the session leaves open of ``TEXT_BATCHES``; the names of these settings."""
    open_ = [key for key in TEXT_BATCHES if spark.conf.get(key, None) is None]
    for key in open_:
        spark.conf.set(key, TEXT_BATCHES[key])
    return open_


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """Inside, jobs that run hand texts to Python in batches of bounded size; after it the session is as before."""
    made = _bound_batches(spark)
    try:
        yield
    finally:
        for key in made:
            spark.conf.unset(key)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, from ``spark.checkpoint.dir``.

    Only a local session may go without the setting: it gets a fresh temporary
    folder, once per session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def settle(df: DataFrame, label: str = "stage", along: str | None = None, wide: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a result feeds several later jobs: the lineage ends at the written
    table, so a lost executor costs a re-read and not a recomputation.

    ``along`` names a column that later aggregates group by: files hold ranges of it, so
    that their map side combines well.  The range goes on over a hash of the row, so a
    value that holds many rows is split.  ``wide`` writes at least one file per core, for
    readers that do much work per row.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if along:
        keys = [F.col(along), F.xxhash64(*df.columns)]
        cores = spark.sparkContext.defaultParallelism
        df = df.repartitionByRange(cores, *keys) if wide else df.repartitionByRange(*keys)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
