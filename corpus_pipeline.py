"""The corpus pipeline: documents through four stages, each written as Parquet and read again.

1. ``language_id`` rejects documents whose language can't be told.
2. ``near_dedup`` keeps one document of each group of near copies (five-word shingles, similarity 0.8).
3. ``decontaminate`` removes documents that hold a passage of the benchmark.
4. ``pack`` lays what is left in sequences of token ids along a space-filling curve.

All but the last return the columns of ``documents``; each stage works on all that the stage before it kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kohorta.llm.common import read
from kohorta.llm.decontaminate import decontaminate
from kohorta.llm.language import keep_identified
from kohorta.llm.near_dup import drop_near_duplicates
from kohorta.llm.packing import pack
from kohorta.session import configure, settle

VOCABULARY = "word_bpe_49k.json"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark, texts=True)
    return keep_identified(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark, texts=True)
    return drop_near_duplicates(docs, words=5, percent=80)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark, texts=True)
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    configure(spark, texts=True)
    pieces = pack(docs, public_tokenizers.path(VOCABULARY))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("pack", pack_stage),
]

# Language identification and packing are models and byte codes, beyond SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
