"""Word rules, n-gram hashes and small Spark helpers that the text operators share.

Texts travel as UTF-8 bytes: lower-casing A-Z and both word rules touch ASCII only, so bytes give the same
words as characters and nothing needs decoding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT = 1 << 18  # n-grams hashed at a time, which bounds memory on very long texts
KNOWN = 1 << 16  # words whose hashes a task remembers
_BASE = np.uint64(0x9E3779B97F4A7C15)
# Everything but digits, small letters and bytes of non-ASCII characters ends a word.
_ALNUM = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_table(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the id (long), the text as bytes (null: empty) and the named columns; others cannot clash."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), *(F.col(f"`{c}`") for c in more)
    )


def space_words(text: bytes) -> list[bytes]:
    """Words between white space, A-Z lower-cased."""
    return text.lower().split()


def alnum_words(text: bytes) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return text.lower().translate(_ALNUM).split()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _WordHashes(dict):
    """XXH64 of words; the dictionary is emptied when full, long words are not kept."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= KNOWN:
                self.clear()
            self[word] = found
        return found


_word_hashes = _WordHashes()


def ngram_hashes(words: list[bytes], n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive words, in order (empty if there are fewer words).

    Each word is hashed as a whole, whatever its length; the n values are chained by multiplication and mixing.
    """
    out = []
    for at in range(0, max(len(words) - n + 1, 0), SEGMENT):
        part = words[at : at + SEGMENT + n - 1]
        single = np.fromiter(map(_word_hashes.__getitem__, part), np.uint64, len(part))
        size = len(part) - n + 1
        value = np.full(size, n, np.uint64)
        for k in range(n):
            value = (value ^ single[k : k + size]) * _BASE
            value ^= value >> np.uint64(29)
        out.append(mix(value))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_set(words: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; a shorter text is one shingle, no words are none."""
    return np.unique(ngram_hashes(words, min(n, len(words)))) if words else np.empty(0, np.uint64)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with a function from one batch to columns of the result.

    The columns are plain sequences; a batch that yields None adds nothing.
    """
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = fn(batch)
                if columns is not None:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[f.name], f.type) for f in arrow], schema=arrow
                    )

    return df.mapInArrow(run, kind)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def filter_texts(docs: DataFrame, text_col: str, keep: Callable[[list[bytes]], list[bool]]) -> DataFrame:
    """The rows of ``docs`` whose text ``keep`` accepts; columns of any name and type pass unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()
                yield batch.filter(pa.array(keep([t or b"" for t in texts]), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
