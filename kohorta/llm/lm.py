"""Language-model scores of whole documents: a recurrent model over words next to the unigram base score.

1. Counts of all training tokens (words between white space, A-Z lower-cased, then one end mark per document).
2. The most frequent words, ``FREQUENT`` at most whatever the corpus, travel as a broadcast table; the counts of all
   other words meet the documents in a join on the word.  Each of them makes up less than one ``FREQUENT``-th of the
   tokens (counts that share a logarithmic bin with the table's limit apart), so no key of that join is hot.
3. The most frequent words are the model's head symbols; every other word belongs to a tail class by its last byte.
   Inside its class a tail word has probability (c + 0.5) / (n + 0.5 * (v + 1)) from the class's n tokens and v words,
   c being its count; one such share of 0.5 is left for unseen words.
4. Training: ``ROUNDS`` rounds, each over its own share of all training documents; in a round every task trains on the
   documents of its partition, state carried across windows, and the weights of the tasks are averaged by tokens in an
   aggregation.  Every training document is used once.
5. Scores: state carried over each whole document, log10 of P(class) * P(word in class).

Defined results: null text is empty, so its only token is the end mark; without training documents every base term is
0 and the model is the untrained one; repeated rows are scored one by one; other columns are ignored; an empty
table gives an empty result.  A null id belongs to the fold of the empty text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohorta.llm import recurrent
from kohorta.llm.common import column, map_batches, space_words, text_table
from kohorta.session import settle

FREQUENT = 1 << 16
ROUNDS = 3
TAILS = 28
TOKENS_HELD = 4_000_000  # a task trains and scores this many tokens at a time, in whole documents
_DISTINCT_HELD = 300_000


def tail_class(word: bytes) -> int:
    """a to z, other ASCII, other: by the last byte."""
    last = word[-1]
    return last - 97 if 97 <= last <= 122 else 26 if last < 128 else 27


def count_words(docs: DataFrame) -> DataFrame:
    """word, c, tail of all words; sums in each task come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for text in column(batch, "text"):
                held.update(space_words(text))
                if len(held) > _DISTINCT_HELD:
                    yield flush(held)
                    held = Counter()
        if held:
            yield flush(held)

    def flush(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"word": list(held), "c": list(held.values())}, schema=pa.schema([("word", pa.binary()), ("c", pa.int64())])
        )

    counts = docs.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    return counts.withColumn("tail", _tail(F.col("word")))


def _tail(word: Column) -> Column:
    """``tail_class`` of a word's bytes."""
    last = F.conv(F.hex(F.substring(word, -1, 1)), 16, 10).cast("int")
    return F.when(last.between(97, 122), last - 97).when(last < 128, 26).otherwise(27)


class Vocabulary:
    """What the tasks need to know of the corpus; its size is bounded by ``FREQUENT``."""

    def __init__(self, tokens: int, types: int, ends: int, words: list[tuple[bytes, int]], tails: dict[int, tuple[int, int]]) -> None:
        """``words``: the frequent ones, most frequent first; ``tails``: tokens and words by class, of all words."""
        self.tokens, self.types, self.ends = tokens, types, ends
        n_head = recurrent.head_size(types) - 1
        head = sorted([*words[:n_head], (None, ends)], key=lambda w: (-w[1], w[0] or b""))
        self.end = next(k for k, (w, _) in enumerate(head) if w is None)
        self.index: dict[bytes, int] = {w: k for k, (w, _) in enumerate(head) if w is not None}
        counts = [c for _, c in head]
        symbol = list(range(len(head)))
        mass = {t: list(tails.get(t, (0, 0))) for t in range(TAILS)}
        for w, c in words[:n_head]:
            mass[tail_class(w)][0] -= c
            mass[tail_class(w)][1] -= 1
        self.below = np.array([mass[t][0] + 0.5 * (mass[t][1] + 1) for t in range(TAILS)])
        inside = [0.0] * len(head)
        for w, c in words[n_head:]:
            self.index[w] = len(counts)
            counts.append(c)
            t = tail_class(w)
            symbol.append(len(head) + t)
            inside.append(float(np.log10((c + 0.5) / self.below[t])))
        self.symbol, self.inside = np.array(symbol, np.int32), np.array(inside)
        self.base = np.array([self.base_term(c) for c in counts])
        self.seen = np.array(counts) > 0
        self.frequency = np.concatenate((np.array(counts[: len(head)], float) + 0.5, self.below))
        self.head = len(head)

    def base_term(self, c: int) -> float:
        return float(np.log10((c + 0.5) / (self.tokens + 0.5 * (self.types + 1))))

    def encode(self, text: bytes) -> tuple[np.ndarray, float, float, int, int, bytes]:
        """Symbols, base and in-class log10 sums and known tokens of the frequent words, tokens, other words."""
        words = space_words(text)
        get = self.index.get
        found = np.array([get(w, -1) for w in words], np.int64)
        rare = np.flatnonzero(found < 0)
        others = [words[k] for k in rare.tolist()]
        known = found[found >= 0] if len(rare) else found
        symbols = np.append(self.symbol[found] if len(found) else np.empty(0, np.int32), self.end).astype(np.uint16)
        if len(rare):
            symbols[rare] = [self.head + tail_class(w) for w in others]
        base = float(self.base[known].sum()) + self.base[self.end]
        n_known = int(self.seen[known].sum()) + int(self.seen[self.end])
        return symbols, base, float(self.inside[known].sum()), n_known, len(words) + 1, b" ".join(others)


def vocabulary(training: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The bounded table and the counts of the words outside it."""
    counts = settle(count_words(training), "counts")
    ends = training.count()
    by_tail = {r["tail"]: (r["n"], r["v"]) for r in counts.groupBy("tail").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    tokens = ends + sum(n for n, _ in by_tail.values())
    types = sum(v for _, v in by_tail.values()) + (ends > 0)
    sizes = counts.groupBy(_bin().alias("bin")).count().orderBy(F.desc("bin")).collect()  # a few hundred rows
    least, held = None, 0
    for r in sizes:
        held += r["count"]
        if held > FREQUENT:
            break
        least = r["bin"]
    none = F.lit(False) if least is None else _bin() >= least
    found = counts.where(none).select("word", "c").collect()  # at most FREQUENT rows
    words = sorted(((bytes(r["word"]), r["c"]) for r in found), key=lambda w: (-w[1], w[0]))
    return Vocabulary(tokens, types, ends, words, by_tail), counts.where(~none)


def _bin() -> Column:
    """Fine logarithmic bins of the counts."""
    return F.floor(F.log("c") * 64)


def encode(docs: DataFrame, vocab) -> DataFrame:
    """One row per document: symbols (compressed), sums over frequent words, and the other words between spaces."""
    table = docs.withColumn("row", F.monotonically_increasing_id())

    def run(batch: pa.RecordBatch) -> dict:
        packer = zstandard.ZstdCompressor(level=1)
        rows = [vocab.value.encode(t) for t in column(batch, "text")]
        return {
            "row": column(batch, "row"),
            "doc_id": column(batch, "doc_id"),
            "held_out": column(batch, "held_out"),
            "symbols": [packer.compress(r[0].tobytes()) for r in rows],
            "base": [r[1] for r in rows],
            "inside": [r[2] for r in rows],
            "known": [r[3] for r in rows],
            "n_tokens": [r[4] for r in rows],
            "others": [r[5] or None for r in rows],
        }

    return map_batches(
        table,
        run,
        "row long, doc_id long, held_out boolean, symbols binary, base double, inside double, known long, "
        "n_tokens long, others binary",
    )


def rare_sums(rows: DataFrame, rare: DataFrame, vocab: Vocabulary) -> DataFrame:
    """row, base, inside, known: sums over the words outside the frequent ones, by a join with their counts."""
    words = rows.where("others is not null").select("row", F.explode(F.split(F.col("others").cast("string"), " ")).alias("w"))
    known = rare.select(F.col("word").cast("string").alias("w"), "c")
    joined = words.join(known, "w", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    below = F.element_at(F.array(*(F.lit(float(b)) for b in vocab.below)), _tail(F.col("w").cast("binary")) + 1)
    total = vocab.tokens + 0.5 * (vocab.types + 1)
    return joined.groupBy("row").agg(
        F.sum(F.log10((F.col("c") + 0.5) / total)).alias("rare_base"),
        F.sum(F.log10((F.col("c") + 0.5) / below)).alias("rare_inside"),
        F.sum((F.col("c") > 0).cast("long")).alias("rare_known"),
    )


def _documents(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[list[np.ndarray], dict[str, list]]]:
    """Symbols of whole documents with some columns, up to ``TOKENS_HELD`` tokens (or one longer document) at a time."""
    unpacker = zstandard.ZstdDecompressor()
    docs: list[np.ndarray] = []
    data: dict[str, list] = {n: [] for n in names}
    held = 0
    for batch in batches:
        columns = [column(batch, n) for n in names]
        for k, packed in enumerate(column(batch, "symbols")):
            docs.append(np.frombuffer(unpacker.decompress(packed), np.uint16))
            for n, c in zip(names, columns, strict=True):
                data[n].append(c[k])
            held += len(docs[-1])
            if held >= TOKENS_HELD:
                yield docs, data
                docs, data, held = [], {n: [] for n in names}, 0
    if docs:
        yield docs, data


def train(rows: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after all rounds; each round averages what the tasks have learnt, weighted by tokens."""
    spark = rows.sparkSession
    weights = recurrent.Model(vocab.frequency, vocab.end).flat
    share = F.pmod(F.xxhash64("row", F.lit(3)), F.lit(rounds))
    known = rows.where(~F.col("held_out")).select("row", "symbols")
    tasks = max(spark.sparkContext.defaultParallelism, known.rdd.getNumPartitions() // rounds)  # as much a task as in one round
    for k in range(rounds):
        now = spark.sparkContext.broadcast((vocab.frequency, vocab.end, weights))
        rate = recurrent.RATE * 0.6**k

        def run(batches: Iterator[pa.RecordBatch], now=now, rate=rate) -> Iterator[pa.RecordBatch]:
            model = recurrent.Model(*now.value)
            tokens = 0
            for docs, _ in _documents(batches):
                model.train(docs, rate)
                tokens += sum(map(len, docs))
            if tokens:
                change = (model.flat - now.value[2]).astype(np.float64) * tokens
                yield pa.RecordBatch.from_pydict({"tokens": [float(tokens)], "change": [change]}, schema=schema)

        schema = pa.schema([("tokens", pa.float64()), ("change", pa.list_(pa.float64()))])
        learnt = known.where(share == k).coalesce(tasks).mapInArrow(run, "tokens double, change array<double>")
        sums = learnt.select("tokens", F.posexplode("change").alias("at", "v")).groupBy("at").agg(
            F.sum("v").alias("v"), F.sum("tokens").alias("n")
        )
        got = sums.collect()  # one row per weight
        if got:
            change = np.zeros(len(weights))
            for r in got:
                change[r["at"]] = r["v"] / r["n"]
            weights = (weights + change).astype(np.float32)
    return weights


def lm_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, rounds: int = ROUNDS
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Rows where ``held_out`` is true are scored only.
    """
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    table = text_table(docs.withColumn("held_out", held), id_col, text_col, "held_out")
    vocab, counts = vocabulary(table.where("not held_out"))
    sc = docs.sparkSession.sparkContext
    rows = settle(encode(table, sc.broadcast(vocab)), "encoded")
    model = sc.broadcast((vocab.frequency, vocab.end, train(rows, vocab, rounds)))
    names = ("row", "doc_id", "held_out", "n_tokens", "known", "base", "inside")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = recurrent.Model(*model.value)
        for texts, data in _documents(batches, *names):
            data["score"] = own.log_probabilities(texts) / np.log(10)
            yield pa.RecordBatch.from_pydict(data, schema=schema)

    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
    schema = pa.schema(list(zip((*names, "score"), kinds, strict=True)))
    scored = rows.select(*names, "symbols").mapInArrow(
        run, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, inside double, score double"
    )
    both = scored.join(rare_sums(rows, counts, vocab), "row", "left")
    rare = lambda name: F.coalesce(name, F.lit(0))
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + rare("rare_known")).cast("long").alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + rare("rare_base")).alias("base_score"),
        (F.col("score") + F.col("inside") + rare("rare_inside")).alias("score"),
    )
