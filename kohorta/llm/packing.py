"""Packing along a space-filling curve.

Documents become token ids plus an end id.  A hashed vector of each document (token counts by hashed id, square-rooted,
unit length) is projected to ``DIMS`` dimensions by a fixed random sign matrix, standardised over all documents and
cut into ``2**BITS`` equally likely cells; the Hilbert index of its cell places a document on the curve.  Documents
are range-sorted by (index, row) and their ids laid end to end along the curve: a running sum inside each range plus the
totals of the ranges before gives each document its global start, and sequence k holds the ids
[k * length, (k + 1) * length).  So neighbours on the curve share sequences, documents are cut freely, and only the
last sequence can be shorter; it is padded by the reader unless it ends at a power of two.

Defined results: null text is empty and gives the end id alone; repeated rows are packed one by one; other columns are
ignored; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohorta.llm.common import column, map_batches, text_table
from kohorta.llm.tokens import word_ids
from kohorta.session import settle

END = 1
LENGTH = 2048
HASHED = 1024
DIMS = 4
BITS = 10
RANGE_ROWS = 50_000
_SIGNS = np.where(np.random.default_rng(99).random((HASHED, DIMS)) < 0.5, -1.0, 1.0).astype(np.float32)


def project(ids: np.ndarray) -> list[float]:
    """The document's hashed vector in a few dimensions."""
    places = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(22)
    counts = np.sqrt(np.bincount(places, minlength=HASHED)).astype(np.float32)
    return ((counts / max(float(np.sqrt(counts @ counts)), 1e-9)) @ _SIGNS).astype(float).tolist()


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert indices of integer points (n, dims) on a grid of 2**bits cells a side (Skilling's transform)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            swap = (x[0] ^ x[i]) & p
            flip = (x[i] & q) != 0
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(flip, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[-1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def tokenised(docs: DataFrame, path: str, end: int) -> DataFrame:
    """row, doc_id, n (ids with the end id), point (projection), ids (compressed, without the end id)."""
    table = docs.withColumn("row", F.monotonically_increasing_id())

    def run(batch: pa.RecordBatch) -> dict:
        packer = zstandard.ZstdCompressor(level=1)
        ids = word_ids(path).ids(column(batch, "text"))
        return {
            "row": column(batch, "row"),
            "doc_id": column(batch, "doc_id"),
            "n": [len(i) + 1 for i in ids],
            "point": [project(i) for i in ids],
            "ids": [packer.compress((i if len(i) and i.max() > 65535 else i.astype("<u2")).tobytes()) for i in ids],
            "wide": [bool(len(i) and i.max() > 65535) for i in ids],
        }

    return map_batches(table, run, "row long, doc_id long, n long, point array<double>, ids binary, wide boolean")


def curve_starts(rows: DataFrame) -> DataFrame:
    """row, part, before (ids of the part before this document) along the curve; parts follow each other."""
    spark = rows.sparkSession
    stats = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        *(F.avg(F.col("point")[i]).alias(f"m{i}") for i in range(DIMS)),
        *(F.stddev_pop(F.col("point")[i]).alias(f"s{i}") for i in range(DIMS)),
    ).first()
    mean = np.array([stats[f"m{i}"] or 0.0 for i in range(DIMS)])
    spread = np.array([stats[f"s{i}"] or 1.0 for i in range(DIMS)])

    def place(batch: pa.RecordBatch) -> dict:
        z = (np.array(column(batch, "point")) - mean) / np.maximum(spread, 1e-12)
        level = 1 / (1 + np.exp(-1.702 * np.clip(z, -8, 8)))  # close to the normal distribution function
        cells = np.minimum((level * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
        return {"row": column(batch, "row"), "n": column(batch, "n"), "place": hilbert(cells)}

    placed = map_batches(rows.select("row", "n", "point"), place, "row long, n long, place long")
    parts = max(1, -(-stats["rows"] // RANGE_ROWS))
    dealt = placed.repartitionByRange(int(parts), "place", "row").sortWithinPartitions("place", "row")
    dealt = dealt.withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            if batch.num_rows:
                n = np.array(column(batch, "n"))
                ends = total + np.cumsum(n)
                total = int(ends[-1])
                data = {"row": column(batch, "row"), "part": column(batch, "part"), "before": ends - n, "n": n}
                yield pa.RecordBatch.from_pydict(
                    data, schema=pa.schema([("row", pa.int64()), ("part", pa.int32()), ("before", pa.int64()), ("n", pa.int64())])
                )

    laid = settle(dealt.mapInArrow(run, "row long, part int, before long, n long"), "curve")
    totals = laid.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # one row per range
    bases = [0, *accumulate(r["n"] for r in totals)]
    table = spark.createDataFrame([(r["part"], b) for r, b in zip(totals, bases)], "part int, base long")
    return laid.join(F.broadcast(table), "part").select("row", (F.col("before") + F.col("base")).alias("at"))


def pack(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end: int = END,
    length: int = LENGTH,
) -> DataFrame:
    """doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset of every piece."""
    rows = settle(tokenised(text_table(docs, id_col, text_col), path, end), "tokens")
    joined = rows.select("row", "doc_id", "n", "ids", "wide").join(curve_starts(rows), "row")
    names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        out: list[tuple] = []
        held = 0
        for batch in batches:
            for doc, n, packed, wide, at in zip(
                *(column(batch, c) for c in ("doc_id", "n", "ids", "wide", "at")), strict=True
            ):
                ids = np.frombuffer(unpacker.decompress(packed), "<u4" if wide else "<u2").astype("<u4")
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                for k in range(at // length, (at + n - 1) // length + 1):
                    lo, hi = max(0, k * length - at), min(n, (k + 1) * length - at)
                    out.append((doc, lo, hi - lo, ids[lo:hi].tobytes(), n, k, at + lo - k * length))
                    held += hi - lo
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*out))), schema=PIECES)
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*out))), schema=PIECES)

    return joined.mapInArrow(
        cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )


PIECES = pa.schema(
    [(n, pa.binary() if n == "ids" else pa.int64()) for n in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")]
)
