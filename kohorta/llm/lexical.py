"""Ranked lexical search over posting lists in geometric blocks.

Every document becomes a sparse vector of integer impacts.  Documents are indexed in segments of ``SEGMENT``; in a segment
each term has a posting list.  A list is clustered by document similarity: vectors are projected to ``DIMS`` signed
sums, a few documents of the list serve as centres, and each posting goes to the centre with the largest cosine.  A
block stores the coordinatewise maximum of its documents' impacts, the list and the segment store that of all of theirs.

Search: the terms of a query are taken in one fixed order, rarest first.  When a list is reached, all documents with an earlier
term are settled, so the bound of what is left is the sum over this and later terms.  If the segment's summary does
not reach the least score still wanted, the query ends there; else each block whose own summary does not reach it is skipped;
documents of the other blocks are scored exactly.  Bounds are exact integers and a tie is skipped only where no smaller id
can come, so the result equals a full scan.  Blocks are built when the first query reaches the list and serve all others.

On Spark: one pass turns texts to vectors over the terms of the query set (other terms cannot score) and counts, per task, the
corpus statistics; a second pass searches its segments and returns each task's best ``k`` per query, merged in two steps.
Queries are taken in blocks of at most ``TERMS`` distinct terms and ``QUERIES`` queries, so broadcasts and dense segments are
bounded whatever the number of queries is; a block reads the documents once.

Defined results: null text has no terms and is not ranked; a query without terms has no rows.  Equal scores rank by ascending
doc_id, a null id last; rows that repeat an id are ranked one by one, and so is each row of the query table, repeated
item ids included.  Empty tables give an empty result; other columns of the inputs are ignored.  Very long texts are read in
pieces.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kohorta.llm.common import alnum_words, column, text_table
from kohorta.session import settle

SEGMENT = 2048  # documents of a segment
TERMS = 8192  # distinct terms of a block of queries
QUERIES = 1024
BLOCK = 32  # postings of a block, about
DIMS = 16
PIECE = 1 << 20  # bytes of a text split at a time
NO_ID = (1 << 63) - 1  # orders a null id behind all others
_GAP = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")


def pieces(text: bytes) -> Iterator[bytes]:
    """The text cut between words about every ``PIECE`` bytes."""
    at = 0
    while len(text) - at > PIECE:
        gap = _GAP.search(text, at + PIECE)
        if gap is None:
            break
        yield text[at : gap.start()]
        at = gap.end()
    yield text[at:] if at else text


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms of the text), terms and counts of those in ``vocabulary``, of documents with a term.

    The last row of a task (``stat``) holds its number of documents and sums of n, document frequencies by term.
    """
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, names = known.value.get, ["doc_id", "n", "terms", "counts", "stat", "docs"]
        df, total, n_docs = np.zeros(len(known.value), np.int64), 0, 0
        types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.bool_(), pa.int64()]
        pack = lambda columns: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(column(batch, "doc_id"), column(batch, "text"), strict=True):
                found: Counter = Counter()
                n = 0
                for piece in pieces(text):
                    words = alnum_words(piece)
                    n += len(words)
                    found.update(map(get, words))
                found.pop(None, None)
                if n:
                    terms = np.fromiter(found, np.int32, len(found))
                    df[terms] += 1
                    total, n_docs = total + n, n_docs + 1
                    row = (doc_id, n, terms, np.fromiter(found.values(), np.int64, len(found)), False, None)
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
            if out[0]:
                yield pack(out)
        if n_docs:
            hit = np.flatnonzero(df)
            yield pack([[None], [total], [hit.astype(np.int32)], [df[hit]], [True], [n_docs]])

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>, stat boolean, docs long")


class Segment:
    """Documents as a dense table of impacts with posting lists, blocked where a query needs it."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int) -> None:
        self.ids = ids
        self.table = np.zeros((len(ids), n_terms), np.int32)
        self.table[rows, terms] = impacts
        self.most = self.table.max(axis=0).astype(np.int64)
        order = np.lexsort((rows, terms))
        self.postings = rows[order]
        self.bounds = np.searchsorted(terms[order], np.arange(n_terms + 1))
        signs = np.random.default_rng(11).choice(np.array([-1.0, 1.0], np.float32), (n_terms, DIMS))
        order = np.argsort(rows, kind="stable")
        drawn = signs[terms[order]] * impacts[order, None].astype(np.float32)
        ends = np.searchsorted(rows[order], np.arange(len(ids) + 1))
        sums = np.concatenate((np.zeros((1, DIMS)), np.cumsum(drawn, axis=0, dtype=np.float64)))
        self.points = sums[ends[1:]] - sums[ends[:-1]]
        self.points /= np.maximum(np.linalg.norm(self.points, axis=1, keepdims=True), 1e-9)
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def blocked(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents of the list by block, starts of the blocks, their summaries and their least ids."""
        if term not in self.blocks:
            docs = self.postings[self.bounds[term] : self.bounds[term + 1]]
            centres = docs[::BLOCK]
            home = (self.points[docs] @ self.points[centres].T).argmax(axis=1)
            order = np.argsort(home, kind="stable")
            docs, home = docs[order], home[order]
            starts = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1])))
            cuts = [*starts.tolist(), len(docs)]
            summary = np.stack([self.table[docs[a:b]].max(axis=0) for a, b in zip(cuts, cuts[1:], strict=False)])
            self.blocks[term] = docs, starts, summary, np.minimum.reduceat(self.ids[docs], starts)
        return self.blocks[term]

    def search(self, terms: np.ndarray, weights: np.ndarray, best: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
        """``best``, (score, -id) of at most k documents, with those of this segment; terms rarest first."""
        reach = np.cumsum((self.most[terms] * weights)[::-1])[::-1]
        seen = np.zeros(len(self.ids), bool)
        for j, term in enumerate(terms):
            least, last = best[-1] if len(best) == k else (1, -NO_ID - 1)
            if reach[j] < least:
                break
            if self.bounds[term] == self.bounds[term + 1]:
                continue
            docs, starts, summary, first = self.blocked(term)
            bound = summary[:, terms[j:]].astype(np.int64) @ weights[j:]
            alive = (bound > least) | ((bound == least) & (-first > last))
            if not alive.any():
                continue
            wanted = docs[np.repeat(alive, np.diff(np.append(starts, len(docs))))]
            wanted = wanted[~seen[wanted]]
            seen[wanted] = True
            scores = self.table[np.ix_(wanted, terms)].astype(np.int64) @ weights
            good = np.flatnonzero(scores >= least)
            if len(good):
                found = zip(scores[good].tolist(), (-self.ids[wanted[good]]).tolist(), strict=True)
                best = sorted([*best, *found], reverse=True)[:k]
        return best


def plan(df: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Weight of each term, and the rank of each term with weight above 0 in the order rarest first (else -1)."""
    ratio = [np.log((2 * n_docs + 2) / (2 * d + 1)) if d else 0.0 for d in df.tolist()]
    weight = np.floor(1000 * np.array(ratio)).astype(np.int64)
    order = np.lexsort((np.arange(len(df)), -weight))
    rank = np.full(len(df), -1, np.int32)
    rank[order] = np.arange(len(df))
    rank[weight <= 0] = -1
    return weight, rank


def _search_block(table: DataFrame, queries: list[tuple[int, Counter]], k: int) -> DataFrame:
    """query, doc_id, score, rank for queries (number, counted terms)."""
    spark = table.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, q in queries for t in q}))}
    vecs = settle(vectors(table, vocabulary), "vectors")
    stats = vecs.where("stat")
    sums = stats.agg(F.sum("docs").alias("d"), F.sum("n").alias("l")).first()
    n_docs, total = sums.d or 0, sums.l or 0
    df = np.zeros(len(vocabulary), np.int64)
    each = stats.select(F.explode(F.arrays_zip("terms", "counts")).alias("e")).groupBy("e.terms").agg(F.sum("e.counts").alias("c"))
    for r in each.collect():
        df[r.terms] = r.c
    weight, rank = plan(df, n_docs)
    ready = []
    for number, counted in queries:
        known = sorted((int(rank[i]), int(weight[i]) * c) for t, c in counted.items() if rank[i := vocabulary[t]] >= 0)
        if known:
            ready.append((number, np.array([r for r, _ in known]), np.array([w for _, w in known])))
    held = spark.sparkContext.broadcast((rank, int((rank >= 0).sum()), ready))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, n_terms, ready = held.value
        size = max(16, min(SEGMENT, SEGMENT * TERMS // max(n_terms, 1)))  # a single query of more than TERMS terms: fewer rows
        best: dict[int, list[tuple[int, int]]] = {number: [] for number, *_ in ready}
        waiting: list[tuple] = []
        count = 0

        def search() -> None:
            nonlocal waiting, count
            ids, n, sizes, terms, tf = (np.concatenate([w[i] for w in waiting]) for i in range(5))
            waiting, count = [], 0
            rows, terms = np.repeat(np.arange(len(ids)), sizes), rank[terms]
            m = 75 + 25 * n * n_docs // total
            impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[rows])
            keep = terms >= 0
            segment = Segment(ids, rows[keep], terms[keep], impact[keep], n_terms)
            for number, own, weights in ready:
                best[number] = segment.search(own, weights, best[number], k)

        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                lists = [part.column(i) for i in (2, 3)]
                sizes = np.diff(lists[0].offsets.to_numpy())
                ids = part.column(0).fill_null(NO_ID).to_numpy()
                waiting.append((ids, part.column(1).to_numpy(), sizes, *(x.flatten().to_numpy() for x in lists)))
                count += len(ids)
                if count >= size:
                    search()
        if count:
            search()
        found = [(q, None if i == -NO_ID else -i, s) for q, rows in best.items() for s, i in rows]
        yield pa.RecordBatch.from_pylist([dict(zip(("query", "doc_id", "score"), f, strict=True)) for f in found], _FOUND)

    hits = vecs.where("not stat").select("doc_id", "n", "terms", "counts").mapInArrow(run, "query long, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for keys in (["query", "part"], ["query"]):  # tasks are merged in groups first, so no window grows with their number
        hits = hits.withColumn("part", F.spark_partition_id() % 64) if "part" in keys else hits
        rank_of = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        hits = hits.withColumn("rank", rank_of).where(F.col("rank") <= k)
    return hits.select("query", "doc_id", "score", "rank")


_FOUND = pa.schema([("query", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, object, Counter]]]:
    """Queries with their terms, in blocks of bounded size; read one partition at a time."""
    block: list[tuple[int, object, Counter]] = []
    terms: set[bytes] = set()
    for number, r in enumerate(items.toLocalIterator()):
        counted = Counter(alnum_words(bytes(r.text)))
        if block and (len(block) >= QUERIES or len(terms | counted.keys()) > TERMS):
            yield block
            block, terms = [], set()
        block.append((number, r.doc_id, counted))
        terms |= counted.keys()
    if block:
        yield block


def lexical_search(
    docs: DataFrame,
    queries: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_id_col: str = "item_id",
    query_text_col: str = "text",
    k: int = 20,
) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring documents of each query."""
    table = text_table(docs, id_col, text_col)
    spark = docs.sparkSession
    parts = []
    for block in _blocks(text_table(queries, query_id_col, query_text_col)):
        hits = _search_block(table, [(n, q) for n, _, q in block], k)
        names = spark.createDataFrame([(n, i) for n, i, _ in block], "query long, item_id long")
        parts.append(hits.join(names, "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = settle(parts[0], "ranked") if len(parts) > 1 else parts[0]
    for part in parts[1:]:
        out = out.unionAll(settle(part, "ranked"))
    return out
