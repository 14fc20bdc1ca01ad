"""Benchmark decontamination with a broadcast hash set of test n-grams.

Items become windows of ``WINDOW`` consecutive words (a shorter item is one window; an item without words has
none).  The distinct windows are counted first: up to ``BLOCK`` of them go to the executors as one broadcast; a
larger benchmark is scanned in blocks of at most that many, and the hits of the blocks are merged per row, so the
broadcast is bounded at any size.  Documents are scanned once per block: rolling 64-bit hashes of their windows are
looked up in the sorted hashes, and each hit is verified on the words themselves.

Defined results: null or word-less texts have no words and no hits; null item ids are ignored in the item list but
their windows hit; repeated rows are judged one by one; other columns of the inputs are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohorta.llm.common import alnum_words, column, filter_texts, map_batches, ngram_hashes, text_table
from kohorta.session import settle

WINDOW = 10
BLOCK = 200_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class WindowSet:
    """Distinct windows by length, with their items; small enough to broadcast."""

    def __init__(self, rows: list) -> None:
        found: dict[int, dict[int, list[tuple[bytes, set[str]]]]] = defaultdict(dict)
        for r in rows:
            entries = found[r.size].setdefault(r.hash, [])
            for words, items in entries:
                if words == bytes(r.window):
                    break
            else:
                items = set()
                entries.append((bytes(r.window), items))
            items.update(i for i in r.items if i is not None)
        self.found = dict(found)
        self.sorted = {n: np.sort(np.array(list(h), np.int64)) for n, h in found.items()}

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the items whose windows occur."""
        marks = np.zeros(len(words) + 1, np.int64)
        items: set[str] = set()
        for size, known in self.sorted.items():
            hashes = ngram_hashes(words, size).view(np.int64)
            if not len(hashes):
                continue
            at = np.searchsorted(known, hashes)
            at[at == len(known)] = 0
            starts = np.flatnonzero(known[at] == hashes)
            for h in np.unique(hashes[starts]).tolist():
                places = starts[hashes[starts] == h]
                text = b" ".join(words[places[0] : places[0] + size])
                for window, names in self.found[size][h]:
                    if window == text:
                        items |= names
                        np.add.at(marks, places, 1)
                        np.add.at(marks, places + size, -1)
        return np.cumsum(marks)[:-1] > 0, items


def windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """hash, window, size and the items it stands in, one row per distinct window."""
    items = benchmark.select(
        F.col(f"`{item_col}`").cast("string").alias("item"),
        F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("text"),
    )

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"hash": [], "window": [], "size": [], "item": []}
        for item, text in zip(column(batch, "item"), column(batch, "text"), strict=True):
            words = alnum_words(text)
            size = min(window, len(words))
            if size:
                hashes = ngram_hashes(words, size).view(np.int64)
                out["hash"] += hashes.tolist()
                out["window"] += [b" ".join(words[k : k + size]) for k in range(len(hashes))]
                out["size"] += [size] * len(hashes)
                out["item"] += [item] * len(hashes)
        return out

    rows = map_batches(items, run, "hash long, window binary, size int, item string")
    return rows.groupBy("hash", "window", "size").agg(F.collect_set("item").alias("items"))


def _sha(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def window_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block: int) -> list[DataFrame]:
    """The distinct windows in blocks of about ``block`` rows at most."""
    found = settle(windows(benchmark, item_col, text_col, window), "windows")
    n = -(-found.count() // block)
    return [found.where(F.pmod(F.xxhash64("hash"), F.lit(n)) == k) for k in range(n)]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block: int = BLOCK,
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``."""
    spark = docs.sparkSession
    table = text_table(docs, id_col, text_col)
    blocks = window_blocks(benchmark, item_col, item_text_col, window, block)
    if len(blocks) <= 1:
        held = spark.sparkContext.broadcast(WindowSet(blocks[0].collect() if blocks else []))

        def run(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")}
            for text in column(batch, "text"):
                words = alnum_words(text)
                hit, items = held.value.scan(words)
                n = int(hit.sum())
                for name, value in zip(out, (len(words), n, len(items), _sha(items), n > 0), strict=True):
                    out[name].append(value)
            return out | {"doc_id": column(batch, "doc_id")}

        return map_batches(table, run, RESULT)
    rows = settle(table.withColumn("row", F.monotonically_increasing_id()), "rows")
    parts = []
    for one in blocks:
        held = spark.sparkContext.broadcast(WindowSet(one.collect()))

        def scan(batch: pa.RecordBatch, held=held) -> dict:
            found = [held.value.scan(alnum_words(t)) for t in column(batch, "text")]
            return {
                "row": column(batch, "row"),
                "hit": [np.packbits(h).tobytes() if h.any() else None for h, _ in found],
                "items": [sorted(i) for _, i in found],
            }

        part = map_batches(rows, scan, "row long, hit binary, items array<string>")
        parts.append(settle(part.where("hit is not null"), "hits"))
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionAll(part)
    joined = rows.join(
        hits.groupBy("row").agg(F.collect_list("hit").alias("hits"), F.flatten(F.collect_list("items")).alias("items")),
        "row",
        "left",
    )

    def merge(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")}
        for text, hits, items in zip(*(column(batch, c) for c in ("text", "hits", "items")), strict=True):
            size = len(alnum_words(text))
            n = 0
            if hits:
                n = int(np.unpackbits(np.bitwise_or.reduce([np.frombuffer(h, np.uint8) for h in hits])).sum())
            names = set(items or [])
            for name, value in zip(out, (size, n, len(names), _sha(names), n > 0), strict=True):
                out[name].append(value)
        return out | {"doc_id": column(batch, "doc_id")}

    return map_batches(joined, merge, RESULT)


def cut_words(text: bytes, hit: np.ndarray) -> bytes:
    """The text without its hit words; what stands between two hit words goes with them."""
    spans = [m.span() for m in _WORD.finditer(text.lower())]
    out, at, k = [], 0, 0
    while k < len(spans):
        if hit[k]:
            last = k
            while last + 1 < len(spans) and hit[last + 1]:
                last += 1
            out.append(text[at : spans[k][0]])
            at, k = spans[last][1], last
        k += 1
    return b"".join([*out, text[at:]])


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block: int = BLOCK,
    remove: str = "documents",
) -> DataFrame:
    """``docs`` without contaminated rows (``remove="documents"``) or with the hit words cut out (``"spans"``).

    Columns are unchanged; each block of windows is one pass over what the last one left.  Spans are cut block
    by block, so a window that another block's cut broke up is not hit any more; its words that were cut are gone.
    """
    spark = docs.sparkSession
    for one in window_blocks(benchmark, item_col, item_text_col, window, block):
        held = spark.sparkContext.broadcast(WindowSet(one.collect()))
        if remove == "documents":
            docs = filter_texts(
                docs, text_col, lambda texts, held=held: [not held.value.scan(alnum_words(t))[0].any() for t in texts]
            )
        elif remove == "spans":

            def cut(batches, held=held):
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    k = batch.schema.get_field_index(text_col)
                    out = []
                    for t in batch.column(k).cast(pa.binary()).to_pylist():
                        hit, _ = held.value.scan(alnum_words(t or b""))
                        out.append(t if t is None or not hit.any() else cut_words(t, hit))
                    texts = pa.array(out, pa.binary()).cast(batch.schema.field(k).type)
                    yield batch.set_column(k, batch.schema.field(k), texts)

            docs = docs.mapInArrow(cut, docs.schema)
        else:
            raise ValueError(f"remove must be 'documents' or 'spans', not {remove!r}")
    return docs
