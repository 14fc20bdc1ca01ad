"""Hierarchical language identification with linear support vector machines.

Each text becomes a vector of ``DIM`` hashed counts of byte bigrams and trigrams of the whole text (A-Z lower-cased,
digits, punctuation and white space as blanks), square-rooted and scaled to unit length.  A first set of one-versus-
one linear SVMs tells language families apart; inside the predicted family one-versus-one SVMs separate its
languages.  The wins of the pairwise decisions count, margins break ties.  ``score`` is the logistic value of the
smallest margin by which the winner beat a rival on the way down.

Fitting uses a bounded sample of labelled texts: about ``sample`` in all, in equal shares per language, drawn by a hash
of the id and at most twice ``sample`` rows.  That is the only bound; every text is classified whole.

Defined results: null texts, empty ones and texts without a letter are ``und`` with score 0, and so is everything if
there is nothing to learn from.  With one language it is predicted for all others (score 1).  Null languages teach
nothing; a null id counts as an empty one in the fold rule.  Repeated rows are classified one by one; other columns
are ignored.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohorta.llm.common import column, filter_texts, map_batches, text_table

DIM = 4096
SAMPLE = 2400
UNKNOWN = "und"
PIECE = 1 << 20  # bytes of a text that are counted at a time
# Language families by code; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy lb af yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru pl cs sk uk bg sr hr sl be mk bs",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "semitic": "ar he am mt",
    "indic": "hi bn ur pa mr gu ne",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTERS = np.frombuffer(
    bytes(c | 0x20 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)), np.uint8
)
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def features(text: bytes) -> np.ndarray:
    """The unit vector of a text (zero for fewer than two bytes)."""
    counts = np.zeros(DIM, np.int64)
    for at in range(0, len(text), PIECE):
        a = _LETTERS[np.frombuffer(text[max(0, at - 2) : at + PIECE], np.uint8)].astype(np.uint32)
        two = a[:-1] * np.uint32(0x01000193) ^ a[1:] * np.uint32(0x9E3779B1)
        three = two[:-1] * np.uint32(0x85EBCA6B) ^ a[2:] * np.uint32(0xC2B2AE35)
        for codes in (two * np.uint32(0x27D4EB2F), three * np.uint32(0x27D4EB2F)):
            counts += np.bincount(codes >> np.uint32(20), minlength=DIM)
    out = np.sqrt(counts).astype(np.float32)
    norm = float(np.sqrt(out @ out))
    return out / norm if norm else out


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 30) -> np.ndarray:
    """Weights and bias of a linear SVM (hinge loss, squared norm) by dual coordinate descent; y is -1 or 1."""
    rng = np.random.default_rng(7)
    square = np.einsum("ij,ij->i", x, x) + 1
    alpha = np.zeros(len(x))
    w = np.zeros(x.shape[1] + 1, np.float32)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(x)):
            gradient = y[i] * (x[i] @ w[:-1] + w[-1]) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[:-1] += step * x[i]
                w[-1] += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


class Node:
    """One-versus-one machines over some classes."""

    def __init__(self, x: np.ndarray, labels: list[str]) -> None:
        self.classes = sorted(set(labels))
        names = np.array(labels)
        self.pairs = list(combinations(range(len(self.classes)), 2))
        self.weights = []
        for a, b in self.pairs:
            rows = (names == self.classes[a]) | (names == self.classes[b])
            self.weights.append(fit_svm(x[rows], np.where(names[rows] == self.classes[a], 1.0, -1.0)))

    def decide(self, x: np.ndarray) -> tuple[str, float]:
        """The class with most wins, and the least margin by which it beat a rival."""
        if not self.pairs:
            return self.classes[0], np.inf
        margins = [float(w[:-1] @ x + w[-1]) for w in self.weights]
        wins = np.zeros(len(self.classes))
        for (a, b), m in zip(self.pairs, margins, strict=True):
            wins[a if m >= 0 else b] += 1 + np.tanh(abs(m)) / len(self.classes)
        best = int(np.argmax(wins))
        own = [m if a == best else -m for (a, b), m in zip(self.pairs, margins, strict=True) if best in (a, b)]
        return self.classes[best], max(0.0, min(own))


class Model:
    """Families first, then the languages of the predicted one."""

    def __init__(self, x: np.ndarray, langs: list[str]) -> None:
        families = [_FAMILY.get(code, f"only {code}") for code in langs]
        self.root = Node(x, families) if langs else None
        self.leaves = {}
        for family in sorted(set(families)):
            rows = [k for k, f in enumerate(families) if f == family]
            self.leaves[family] = Node(x[rows], [langs[k] for k in rows])

    def predict(self, text: bytes) -> tuple[str, float]:
        if self.root is None or not has_letter(text):
            return UNKNOWN, 0.0
        x = features(text)
        family, first = self.root.decide(x)
        lang, second = self.leaves[family].decide(x)
        return lang, float(1 / (1 + np.exp(-4 * min(first, second))))


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, held_out: Column | None, sample: int = SAMPLE) -> Model:
    """Fit on a sample of the rows that have a language and are not held out."""
    known = text_table(docs, id_col, text_col, lang_col) if held_out is None else text_table(
        docs.where(~held_out), id_col, text_col, lang_col
    )
    known = known.select("doc_id", "text", F.col(f"`{lang_col}`").cast("string").alias("lang")).where("lang is not null")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return Model(np.empty((0, DIM), np.float32), [])
    share = sample / len(counts)
    drawn = F.lit(False)
    place = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    for lang, n in counts.items():
        drawn = drawn | ((F.col("lang") == lang) & (place < min(1.0, share / n)))

    def run(batch: pa.RecordBatch) -> dict:
        rows = [(la, t) for la, t in zip(column(batch, "lang"), column(batch, "text"), strict=True) if has_letter(t)]
        return {"lang": [r[0] for r in rows], "x": [features(r[1]).astype(np.float16).tobytes() for r in rows]}

    rows = map_batches(known.where(drawn).limit(2 * sample), run, "lang string, x binary").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    x = np.array([np.frombuffer(r["x"], np.float16) for r in rows], np.float32).reshape(len(rows), DIM)
    return Model(x, [r["lang"] for r in rows])


def language_id(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    held_out: Column | None = None,
    sample: int = SAMPLE,
) -> DataFrame:
    """doc_id, lang_pred, score for every row; rows where ``held_out`` is true teach nothing."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col, held_out, sample))

    def run(batch: pa.RecordBatch) -> dict:
        found = [model.value.predict(t) for t in column(batch, "text")]
        return {
            "doc_id": column(batch, "doc_id"),
            "lang_pred": [f[0] for f in found],
            "score": [f[1] for f in found],
        }

    return map_batches(text_table(docs, id_col, text_col), run, "doc_id long, lang_pred string, score double")


def keep_identified(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE
) -> DataFrame:
    """``docs`` without the rows whose language can't be told (``und``); columns are unchanged."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col, None, sample))
    return filter_texts(docs, text_col, lambda texts: [model.value.predict(t)[0] != UNKNOWN for t in texts])
