"""License scans: Aho-Corasick for identifier tags and notice phrases, a shunting-yard parser for expressions.

Two automata run over every whole text.  One reads the word sequence (words of digits, letters and non-ASCII
characters, A-Z lower-cased, joined by one space) and finds the phrases of ``BASE`` and ``NOTICES``; the other reads
the lower-cased text and finds the tags of ``TAGS``.  After a tag stands a licence expression: identifiers, ``and``,
``or``, ``with`` and parentheses on one line.  The parser reads as long as the expression can go on, so its length
needs no limit; it ends before prose, and a dangling operator or open parenthesis is dropped.  Unknown identifiers
give no label and are not permitted.  ``with`` binds closer than ``and``, ``and``
closer than ``or``.  The value of an expression is whether the given policy permits it.

Defined results: null and empty texts have no words and no labels, score 0 and ``permitted`` null.  Repeated rows
are scanned one by one; other columns of the input are ignored.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from kohorta.llm.common import alnum_words, column, map_batches, text_table

# Phrases as word sequences and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0 universal": "cc0",
}
TAGS = ("spdx-license-identifier:", "license-expression:")
# Stems of identifiers; a version or variant may follow after a sign. First match wins.
IDENTIFIERS = (
    ("mit", "mit"), ("apache-2", "apache-2"), ("cc-by-nc", "cc-by-nc"), ("cc-by-sa", "cc-by-sa"), ("cc-by-nd", "cc-by-nd"),
    ("cc0", "cc0"), ("gpl-2", "gpl-2"), ("gpl-3", "gpl-3"), ("lgpl", "lgpl"), ("agpl", "agpl"), ("mpl", "mpl"), ("bsd", "bsd"),
    ("isc", "isc"), ("zlib", "zlib"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"), ("proprietary", "proprietary"),
)
PERMITTED = frozenset({"mit", "apache-2", "bsd", "cc0", "mpl", "lgpl"})
EXCEPTIONS = frozenset({"classpath-exception-2.0", "gcc-exception-3.1", "llvm-exception", "linux-syscall-note"})
RANK = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(rb"[ \t]*([()]|[0-9a-z][0-9a-z.+:-]*)")
RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double, n_tags long, permitted boolean"
)


def automaton(patterns: dict[str, object]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for pattern, value in patterns.items():
        out.add_word(pattern, (len(pattern), value))
    out.make_automaton()
    return out


def to_rpn(text: bytes, at: int) -> list[str]:
    """The expression that starts at byte ``at`` of a lower-cased text, in reverse Polish order."""
    out: list[str] = []
    held: list[str] = []
    operand = True  # whether an identifier or "(" has to come next
    while m := _TOKEN.match(text, at):
        word = m[1].decode()
        if operand and (word == "(" or word not in RANK and word != ")"):
            if word == "(":
                held.append(word)
            elif is_identifier(name := word.rstrip(".:")):
                out.append(name)
                operand = False
            else:
                break
        elif not operand and word in RANK:
            while held and held[-1] != "(" and RANK[held[-1]] >= RANK[word]:
                out.append(held.pop())
            held.append(word)
            operand = True
        elif not operand and word == ")" and "(" in held:
            while (top := held.pop()) != "(":
                out.append(top)
        else:
            break
        at = m.end()
    if operand:  # an operator or "(" without what should follow
        while held and held[-1] == "(":
            held.pop()
        if held:
            held.pop()
    out += [x for x in reversed(held) if x != "("]
    return out


def label(identifier: str) -> str | None:
    """Label of an identifier: a stem alone, or with a version behind a sign (``mit`` and ``gpl-2.0-only``, not ``mitre-1.0``)."""
    for stem, name in IDENTIFIERS:
        if identifier.startswith(stem) and not identifier[len(stem) : len(stem) + 1].isalnum():
            return name
    return None


def is_identifier(word: str) -> bool:
    """Whether a word can stand in an expression: a known licence, or one with a digit or hyphen; others are prose."""
    return label(word) is not None or re.search("[0-9-]", word) is not None


def evaluate(rpn: list[str], permitted: frozenset[str] = PERMITTED) -> tuple[set[str], bool | None]:
    """Labels that an expression names, and whether the policy permits it: ``and`` needs both sides, ``or`` one,
    ``with`` permits by a known exception too.  An expression without identifiers has no value."""
    stack: list[tuple[str, bool]] = []
    labels: set[str] = set()
    used: list[str] = []
    for word in rpn:
        if word not in RANK:
            stack.append((word, label(word) in permitted))
            used.append(word)
            continue
        if len(stack) < 2:
            continue
        right, left = stack.pop(), stack.pop()
        if word == "with":
            used.remove(right[0])
            stack.append((left[0], left[1] or right[0] in EXCEPTIONS))
        else:
            stack.append((left[0], left[1] and right[1] if word == "and" else left[1] or right[1]))
    labels.update(name for name in map(label, used) if name is not None)
    return labels, stack[-1][1] if stack else None


class Scanner:
    """Both automata and the policy; built once per task."""

    def __init__(self, permitted: frozenset[str]) -> None:
        self.permitted = permitted
        phrases = {f" {p} ": (name, True) for p, name in BASE.items()}
        phrases |= {f" {p} ": (name, False) for p, name in NOTICES.items()}
        self.phrases = automaton(phrases)
        self.tags = automaton(dict.fromkeys(TAGS, True))

    def scan(self, text: bytes) -> tuple:
        words = alnum_words(text)
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        starts: list[int] = []
        base: set[str] = set()
        other: set[str] = set()
        seen, passed = 0, 0  # spaces before a place, counted on from match to match
        for end, (size, (name, is_base)) in self.phrases.iter(line):
            if is_base:
                at = end - size + 1
                seen += line.count(" ", passed, at) if at >= passed else -line.count(" ", at, passed)
                passed = at
                starts.append(seen)
                base.add(name)
            else:
                other.add(name)
        lower = text.lower()
        tags, allowed = 0, [name in self.permitted for name in sorted(base | other)]
        if any(t.encode() in lower for t in TAGS):
            for end, _ in self.tags.iter(lower.decode("latin-1")):
                names, value = evaluate(to_rpn(lower, end + 1), self.permitted)
                if value is not None:
                    tags += 1
                    other |= names
                    allowed.append(value)
        labels = base | other
        score = 1 - 0.1**min(tags, 1) * 0.3 ** len(base) * 0.5 ** len(labels - base) if labels else 0.0
        return (
            len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), score, tags, all(allowed) if allowed else None,
        )


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", permitted: frozenset[str] = PERMITTED
) -> DataFrame:
    """One row per document: base phrases, labels, tags, score and the policy's verdict (all statements permitted)."""
    names = [f.split()[0] for f in RESULT.split(", ")][1:]

    def run(batch: pa.RecordBatch) -> dict:
        scanner = Scanner(permitted)
        rows = [scanner.scan(t) for t in column(batch, "text")]
        return {"doc_id": column(batch, "doc_id")} | {n: [r[k] for r in rows] for k, n in enumerate(names)}

    return map_batches(text_table(docs, id_col, text_col), run, RESULT)
