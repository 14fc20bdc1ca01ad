"""Token counts of flat, unindexed token files by a separator scan.

A token file is nothing but little-endian ids: vocabulary ids plus ``SHIFT``, an end id after each document, no
header and no index.  Ids take two bytes where the vocabulary fits, else four (``id_width``).  ``write_token_files``
lets Spark's text writer put them down: a row is the bytes of a document's ids, the line separator is the bytes of the
end id.  A task writes the documents of its own part of the table, in their order there, without a shuffle, into files of
about ``file_mb`` each (a longer document is a file of its own), and beside them which document stands where: both are
committed as one task's output, so they agree whichever attempt of a task counts.  ``scan_token_files`` reads files in
blocks of ``BLOCK`` ids, finds the end ids of each block with one vectorised comparison at id boundaries, and stitches
documents that cross blocks by a prefix scan over one summary row per block: ids left open by the blocks before it.

Spark's binary reader takes files of up to 2 GB, which only a single document of that size can outgrow.

Defined results: an empty document is 0 ids; ids after the last end id of a file are a document of their own with
``complete`` false; bytes after the last whole id are an error.  Null texts are empty, repeated rows are written and
counted one by one, other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kohorta.llm.common import column, map_batches, text_table
from kohorta.llm.tokens import word_ids
from kohorta.session import scratch_path, settle

SHIFT = 2  # 0 is padding, 1 ends a document
END = 1
BLOCK = 1 << 16
FILES = 1 << 20  # numbers of files set aside for each task


def id_width(vocabulary: str) -> int:
    """Bytes of an id: 2 if all ids of the vocabulary, shifted, are below 65536, else 4."""
    return 2 if word_ids(vocabulary).model.get_vocab_size() + SHIFT <= 1 << 16 else 4


def write_token_files(
    docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", file_mb: int = 32
) -> DataFrame:
    """Write the files into ``path``; returns file_no, ordinal, doc_id: which document stands where."""
    width = id_width(vocabulary)
    kind = np.dtype(f"<u{width}")
    names = ["kind", "file_no", "ordinal", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_no = TaskContext.get().partitionId() * FILES
        ordinal = held = 0
        for batch in batches:
            places, values, found = [], [], column(batch, "doc_id")
            for ids in word_ids(vocabulary).ids(column(batch, "text")):
                data = (ids + np.uint32(SHIFT)).astype(kind).tobytes()
                if ordinal and held + len(data) > file_mb << 20:
                    file_no, ordinal, held = file_no + 1, 0, 0
                places.append((file_no, ordinal))
                values.append(data)
                ordinal, held = ordinal + 1, held + len(data) + width
            lines = [f"{o},{'' if d is None else d}".encode() for (_, o), d in zip(places, found, strict=True)]
            for label, content in (("ids", values), ("docs", lines)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label] * len(content)), *(pa.array([p[k] for p in places], pa.int64()) for k in (0, 1)),
                     pa.array(content, pa.binary())], names,
                )

    laid = text_table(docs, id_col, text_col).mapInArrow(run, "kind string, file_no long, ordinal long, value binary")
    laid = laid.sortWithinPartitions("kind", "file_no", "ordinal").select("kind", "file_no", F.col("value").cast("string"))
    end = np.array([END], kind).tobytes().decode("ascii")
    laid.write.partitionBy("kind", "file_no").option("lineSep", end).text(path)
    lines = docs.sparkSession.read.option("lineSep", end).text(path).where("kind = 'docs'")
    at = F.split("value", ",")
    doc_id = F.when(at[1] != "", at[1]).cast("long")
    return lines.select(F.col("file_no").cast("long"), at[0].cast("long").alias("ordinal"), doc_id.alias("doc_id"))


def scan_token_files(spark: SparkSession, path: str, block: int = BLOCK, end: int = END, width: int = 4) -> DataFrame:
    """file_no, ordinal, n_tokens, first_token (its place in the file), complete for every document of the files.

    Files lie in folders ``file_no=k``, below ``kind=ids`` if others are there too, and hold ids of ``width`` bytes.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0").withColumn("file_no", F.col("file_no").cast("long"))
    files = files.where("kind = 'ids'") if "kind" in files.columns else files
    size, kind = width * block, f"<u{width}"
    places = F.expr(f"explode(sequence(0L, length - 1, {size}L))")
    blocks = files.select("file_no", "length", "content", places.alias("at"))
    blocks = blocks.select(
        "file_no", (F.col("at") / size).cast("long").alias("block"), F.expr(f"substring(content, int(at + 1), {size})").alias("bytes")
    )

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("ids", "ends", "head", "tail", "inner", "starts")}
        for data in column(batch, "bytes"):
            ids = np.frombuffer(data, kind)
            at = np.flatnonzero(ids == end)
            some = len(at) > 0
            row = (len(ids), len(at), int(at[0]) if some else len(ids), len(ids) - 1 - int(at[-1]) if some else len(ids))
            for name, value in zip(("ids", "ends", "head", "tail"), row, strict=False):
                out[name].append(value)
            out["inner"].append(np.diff(at) - 1)
            out["starts"].append(at[:-1] + 1)
        return {"file_no": column(batch, "file_no"), "block": column(batch, "block")} | out

    found = map_batches(
        blocks, run, "file_no long, block long, ids long, ends long, head long, tail long, inner array<long>, starts array<long>"
    )
    found = settle(found, "blocks")
    earlier = Window.partitionBy("file_no").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = found.select(
        "*",
        F.coalesce(F.sum("ends").over(earlier), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("ids_before"),
        F.coalesce(F.sum((F.col("ends") > 0).cast("long")).over(earlier), F.lit(0)).alias("stretch"),
    )
    # a stretch starts with the ids that the block before it left open
    left = Window.partitionBy("file_no").orderBy("block")
    since = Window.partitionBy("file_no", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.when(
        F.lag("stretch").over(left) < F.col("stretch"), F.lag("tail").over(left)
    ).otherwise(F.lit(0))
    found = found.withColumn("opened", F.coalesce(opened, F.lit(0)))
    found = found.withColumn(
        "carried", F.coalesce(F.sum(F.col("opened") + F.col("ids")).over(since), F.lit(0)) + F.col("opened")
    )
    first = F.struct(F.lit(0).alias("k"), (F.col("carried") + F.col("head")).alias("n"), (-F.col("carried")).alias("s"))
    inner = F.transform(
        F.arrays_zip("inner", "starts"), lambda x, k: F.struct((k + 1).alias("k"), x["inner"].alias("n"), x["starts"].alias("s"))
    )
    docs = found.where("ends > 0").select(
        "file_no", "docs_before", "ids_before", F.explode(F.concat(F.array(first), inner)).alias("d")
    )
    whole = docs.select(
        "file_no",
        (F.col("docs_before") + F.col("d.k")).alias("ordinal"),
        F.col("d.n").alias("n_tokens"),
        (F.col("ids_before") + F.col("d.s")).alias("first_token"),
        F.lit(True).alias("complete"),
    )
    last = found.groupBy("file_no").agg(F.max_by(F.struct("*"), "block").alias("l")).select("l.*")
    open_ids = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carried") + F.col("ids"))
    rest = last.select(
        "file_no",
        (F.col("docs_before") + F.col("ends")).alias("ordinal"),
        open_ids.alias("n_tokens"),
        (F.col("ids_before") + F.col("ids") - open_ids).alias("first_token"),
        F.lit(False).alias("complete"),
    ).where("n_tokens > 0")
    return whole.unionAll(rest)


def token_counts(
    docs: DataFrame, vocabulary: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", file_mb: int = 32
) -> DataFrame:
    """doc_id, n_tokens, file_no, ordinal, first_token of every document, counted in files written for it."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-files")
    if docs.isEmpty():
        return spark.createDataFrame([], "doc_id long, n_tokens long, file_no long, ordinal long, first_token long")
    manifest = write_token_files(docs, path, vocabulary, id_col, text_col, file_mb)
    found = scan_token_files(spark, path, width=id_width(vocabulary))
    return found.join(manifest, ["file_no", "ordinal"]).select("doc_id", "n_tokens", "file_no", "ordinal", "first_token")
