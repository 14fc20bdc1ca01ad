"""Registered queries of the text operators: (spark, sf_dir) -> DataFrame over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kohorta.llm import sql
from kohorta.llm.common import read
from kohorta.llm.conversations import damaged, repair
from kohorta.llm.decontaminate import contamination
from kohorta.llm.hnsw import nearest
from kohorta.llm.html_text import extract_text
from kohorta.llm.language import fold, language_id
from kohorta.llm.lexical import lexical_search
from kohorta.llm.licenses import license_scan
from kohorta.llm.lm import lm_scores
from kohorta.llm.near_dup import near_duplicates
from kohorta.llm.packing import pack
from kohorta.llm.simhash import simhash_groups
from kohorta.llm.token_files import token_counts
from kohorta.llm.warc import capture_index
from kohorta.session import configure

VOCABULARY = "word_bpe_49k.json"


def vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(configure(spark), sf_dir, "documents"))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth part of the documents (by crc32 of the id) is held out of learning."""
    docs = read(configure(spark), sf_dir, "documents")
    return lm_scores(docs, held_out=fold(F.col("doc_id"), 5) == 1)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth part of the documents (by crc32 of the id) is held out of learning."""
    docs = read(configure(spark), sf_dir, "documents")
    held = fold(F.col("doc_id"), 4) == 2
    out = language_id(docs, held_out=held)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(read(configure(spark), sf_dir, "documents"), vocabulary())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(configure(spark), sf_dir, "documents"), vocabulary())


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 50; candidates are all rows."""
    return nearest(read(configure(spark), sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(configure(spark), sf_dir, "documents"), words=4)


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = capture_index(read(configure(spark), sf_dir, "pages"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(configure(spark), sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(configure(spark), sf_dir, "pages"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(read(configure(spark), sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read(configure(spark), sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(read(configure(spark), sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_lm_scores, op3_language_id, op4_packing, op5_token_counts, op6_nearest_vectors,
        op7_near_duplicates, op8_warc_index, op9_decontamination, op10_html_text,
        op11_lexical_search, op12_simhash_groups, op13_conversation_repair,
    )
}
SQL = sql.SQL
