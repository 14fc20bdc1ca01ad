"""Class membership as bitmaps of dense subject numbers, for a domain of classes that nobody listed beforehand.

Subjects are numbered from 0 without gaps, so a bitmap of 32768 of them is 4 kB and only (class, bucket) pairs that occur
have one.  Bitmaps are built and united on the map side: what is shuffled is at most one bitmap per task, class and bucket,
however many dispensings a subject has.  Counts are bits; subjects of several classes are unions of bitmaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohorta.session import settle

MOST_CLASSES = 4096  # columns a wide table may have; more classes are an error, not a cut
_PLACE = (1 << 33) - 1  # low bits of monotonically_increasing_id: the row's place in its partition


def subject_numbers(cohort: DataFrame, key: str = "patientid") -> DataFrame:
    """``key, number``: the distinct subjects that are not null, numbered from 0 without gaps, in no stated order.

    The subjects are written first, so that every later job sees the same numbers.
    """
    ids = cohort.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_id", F.monotonically_increasing_id())
    ids = settle(ids, "numbers")
    part = F.shiftright("_id", 33)
    sizes = ids.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per task of the numbering
    all_sizes = sizes.agg(F.array_sort(F.collect_list(F.struct("_part", "_n"))).alias("s"))
    before = F.aggregate(
        F.slice("s", 1, F.col("_at")), F.lit(0).cast("long"), lambda total, x: total + x["_n"]
    )
    offsets = all_sizes.select("s", F.posexplode("s").alias("_at", "p")).select(F.col("p._part").alias("_part"), before.alias("_before"))
    numbered = ids.withColumn("_part", part).join(offsets, "_part")
    return numbered.select(key, (F.col("_before") + F.col("_id").bitwiseAND(_PLACE)).alias("number"))


def class_bitmaps(exposure: DataFrame, numbers: DataFrame, cls: str = "atc3", key: str = "patientid") -> DataFrame:
    """``cls, bucket, bits``: the numbered subjects of every class; rows without a class or number drop out."""
    at = F.col("number") + 1  # buckets count from 1
    placed = exposure.where(F.col(cls).isNotNull()).select(key, cls).join(numbers, key)
    return placed.groupBy(cls, F.bitmap_bucket_number(at).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")
    )


def subjects_per_class(bitmaps: DataFrame, cls: str = "atc3") -> DataFrame:
    """``cls, n``: subjects of each class."""
    return bitmaps.groupBy(cls).agg(F.sum(F.bitmap_count("bits")).alias("n"))


def subjects_of_any(bitmaps: DataFrame, group: dict[str, list[str]], cls: str = "atc3") -> DataFrame:
    """``grp, n``: subjects with at least one class of a named group of classes; each subject counts once."""
    parts = []
    for name, classes in group.items():
        united = bitmaps.where(F.col(cls).isin(classes)).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        parts.append(united.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n")).select(F.lit(name).alias("grp"), "n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def class_domain(exposure: DataFrame, cls: str = "atc3", most: int = MOST_CLASSES) -> list[str]:
    """The classes that occur, in order.  More than ``most`` are an error: such a domain is no set of columns."""
    found = [r[0] for r in exposure.where(F.col(cls).isNotNull()).select(cls).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} classes in {cls}: keep them as rows or bitmaps")
    return sorted(found)
