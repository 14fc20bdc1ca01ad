"""Repair of conversation structure by a persistent audit DP.

Rows of a conversation are edited so that their role initials read ``(s?(ua)+)?``: Keep costs 0, Rerole (to user or
assistant) 2, Delete 3 (the only edit of a blank or duplicate row), Insert of an empty user or assistant row 2; a
truncated row that stays adds 1.  The audit is the string of the edits' initials, the least in ASCII order among the
cheapest.

Method: the DP runs over rows and the four states of the pattern.  A cell keeps its cost and a ``Trail``: a linked node
that shares its prefix with others, with binary-lifting ancestors and the rolling hash of its whole prefix.  Two trails of
equal cost are compared by searching their longest common prefix down the ancestors; equal hashes of distinct nodes are
verified label by label.  Each label holds the Inserts before one row and that row's own edit, so labels of one row never
are prefixes of each other, and trails at one row compare by the first label that differs.

On Spark: damage, the collapse of equal rows and the search for earlier twins are plain columns, aggregates and a join on
unique keys.  Rows then go by range of (conversation, turn, role, text) to tasks, so a conversation of any size is dealt
over many; a task cuts it in runs of at most ``RUN_ROWS`` rows and ``RUN_BYTES`` bytes.  A run yields a table from entry
state to exit state (cost and audit), and the runs of a conversation are joined by the same DP with runs in place of
rows.  A conversation in one run is complete at once; for the others (at most one a task, and those longer than a run)
the digest, a sequential chain by its nature, is fed row by row from a sorted stream: nothing of a conversation is gathered.

Defined results: a null role or text is one space, a null turn sorts first and a null conversation id is a conversation
of its own; rows of one turn are taken by role and text; rows equal in all four columns are repeats of each other, all but
the first being duplicates.  An empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kohorta.session import settle

RUN_ROWS = 20_000
RUN_BYTES = 1 << 25
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: b"user", ASSISTANT: b"assistant"}
WANTED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # where an inserted or re-roled row leads
KEPT = {(START, b"s"): SYSTEM, (START, b"u"): USER, (SYSTEM, b"u"): USER, (USER, b"a"): ASSISTANT, (ASSISTANT, b"u"): USER}
ENDS = {START: (0, b""), ASSISTANT: (0, b""), USER: (INSERT_COST, b"I"), SYSTEM: (2 * INSERT_COST, b"II")}
LEGAL = {b"su", b"ua", b"au"}
SPACE = b" \t\n\x0b\x0c\r"
_BASE, _MOD = 0x5DEECE66D, (1 << 61) - 1


class Trail:
    """A string of labels that shares its prefix: the last label and the node before."""

    __slots__ = ("label", "hash", "up")

    def __init__(self, parent: Trail | None, label: bytes) -> None:
        self.label = label
        self.up: list[Trail] = []  # ancestors at distance 1, 2, 4, ...
        self.hash = 1
        if parent is not None:
            self.hash = (parent.hash * _BASE + hash(label)) % _MOD
            node: Trail | None = parent
            while node is not None:
                self.up.append(node)
                k = len(self.up) - 1
                node = node.up[k] if k < len(node.up) else None

    def text(self) -> bytes:
        out, node = [], self
        while node.up:
            out.append(node.label)
            node = node.up[0]
        return b"".join(reversed(out))


def same(x: Trail, y: Trail) -> bool:
    """Whether two trails of one length hold the same labels."""
    if x is y:
        return True
    if x.hash != y.hash:
        return False
    while x is not y:  # equal hashes do not prove equal labels
        if x.label != y.label or not x.up:
            return x.label == y.label
        x, y = x.up[0], y.up[0]
    return True


def before(x: Trail, y: Trail) -> bool:
    """Whether ``x`` comes before ``y`` (trails of one length): the label behind their longest common prefix decides."""
    if x is y:
        return False
    for k in range(len(x.up) - 1, -1, -1):
        if k < len(x.up) and not same(x.up[k], y.up[k]):
            x, y = x.up[k], y.up[k]
    return x.label < y.label


Cells = dict[int, tuple[int, Trail]]
Edge = tuple[int, int, int, bytes]  # from, to, cost, label


def advance(cells: Cells, edges: Iterable[Edge]) -> Cells:
    """One step of the DP."""
    best: dict[int, tuple[int, Trail, bytes]] = {}
    for source, to, cost, label in edges:
        if source in cells:
            paid, trail = cells[source]
            paid += cost
            have = best.get(to)
            if have is None or paid < have[0]:
                best[to] = (paid, trail, label)
            elif paid == have[0] and (before(trail, have[1]) if trail is not have[1] else label < have[2]):
                best[to] = (paid, trail, label)
    return {to: (cost, Trail(trail, label)) for to, (cost, trail, label) in best.items()}


@functools.cache
def row_edges(initial: bytes, must_go: bool, truncated: bool, copies: int) -> tuple[Edge, ...]:
    """Edits of a row with ``copies`` equal ones at once (all but the first are duplicates and go)."""
    found: dict[tuple[int, int], tuple[int, bytes]] = {}
    more = (DELETE_COST * (copies - 1), b"D" * (copies - 1))
    for source in range(4):
        state, paid, inserts = source, 0, b""
        for _ in range(3):
            edits = [(state, DELETE_COST, b"D")]
            if not must_go:
                late = TRUNCATED_COST if truncated else 0
                edits.append((WANTED[state], REROLE_COST + late, b"R"))
                if (state, initial) in KEPT:
                    edits.append((KEPT[state, initial], KEEP_COST + late, b"K"))
            for to, cost, edit in edits:
                one = (paid + cost + more[0], inserts + edit + more[1])
                found[source, to] = min(one, found.get((source, to), one))
            state, paid, inserts = WANTED[state], paid + INSERT_COST, inserts + b"I"
    return tuple((source, to, cost, label) for (source, to), (cost, label) in found.items())


def finish(cells: Cells) -> tuple[int, bytes]:
    """Cost and audit of the best way to end."""
    best: tuple[int, Trail, bytes] | None = None
    for state, (paid, trail) in cells.items():
        cost, label = ENDS[state]
        if best is None or paid + cost < best[0] or paid + cost == best[0] and before(trail, best[1]):
            best = (paid + cost, trail, label)
    return best[0], best[1].text() + best[2]


def repaired(audit: bytes, rows: Iterable[tuple[bytes, bytes, int]]) -> Iterator[bytes]:
    """The lines ``role:text`` that an audit leaves of the rows (role, text, copies)."""
    each = ((role, text) for role, text, copies in rows for _ in range(copies))
    state = START
    for edit in audit:
        if edit == 73:  # I
            state = WANTED[state]
            yield NAMES[state] + b":"
            continue
        role, text = next(each)
        if edit == 75:  # K
            state = KEPT[state, initial_of(role)]
            yield role + b":" + text
        elif edit == 82:  # R
            state = WANTED[state]
            yield NAMES[state] + b":" + text


def initial_of(role: bytes) -> bytes:
    return role.decode()[:1].encode()


def digest_of(lines: Iterable[bytes]) -> str:
    found = hashlib.sha256()
    for k, line in enumerate(lines):
        if k:
            found.update(b"\n")
        found.update(line)
    return found.hexdigest()


COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
RUN = (
    "conv_id long, part long, run long, whole boolean, n long, blank long, duplicate long, truncated long, illegal long, "
    "turns long, low long, high long, first_role string, last_role string, costs array<long>, audits array<binary>, "
    "cost long, audit string, repaired_sha256 string"
)


class Run:
    """Consecutive rows of one conversation."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.rows, self.size, self.n = conv_id, [], 0, 0
        self.counts = dict.fromkeys(COUNTS, 0)
        self.low = self.high = self.first = self.last = None
        self.cells: dict[int, Cells] = {s: {s: (0, Trail(None, b""))} for s in range(4)}

    def add(self, turn: int | None, role: bytes, text: bytes, copies: int, first: bool) -> None:
        initial, left, counts = initial_of(role), text.rstrip(SPACE), self.counts
        blank = not left
        truncated = bool(left) and first and left[-1:] not in b".!?"
        counts["blank"] += copies if blank else 0
        counts["duplicate"] += 0 if blank else copies - first
        counts["truncated"] += truncated
        counts["illegal"] += copies - 1 + (self.n > 0 and self.last + initial not in LEGAL)
        if turn is not None and turn != self.high:
            counts["turns"] += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.first, self.last = initial if self.n == 0 else self.first, initial
        edges = row_edges(initial, blank or not first, truncated, copies)
        self.cells = {entry: advance(cells, edges) for entry, cells in self.cells.items()}
        self.rows.append((role, text, copies))
        self.size += len(text) + len(role)
        self.n += copies

    def result(self, part: int, run: int, whole: bool) -> dict:
        """Everything as if the conversation were this run, and for an open one the table over entry and exit states."""
        out = {"conv_id": self.conv_id, "part": part, "run": run, "whole": whole, "n": self.n, **self.counts}
        out |= {"low": self.low, "high": self.high, "first_role": _text(self.first), "last_role": _text(self.last)}
        cost, audit = finish(self.cells[START])
        out |= {"cost": cost, "audit": audit.decode(), "repaired_sha256": digest_of(repaired(audit, self.rows))}
        pairs = [] if whole else [self.cells[s].get(e) for s in range(4) for e in range(4)]
        out["costs"] = [c and c[0] for c in pairs]
        out["audits"] = [c and c[1].text() for c in pairs]
        return out


def _text(initial: bytes | None) -> str | None:
    return None if initial is None else initial.decode()


def _batches(rows: Iterable[dict], arrow: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, arrow)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, arrow)


def _stream(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` with a generator over the rows of a partition."""
    kind = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(fn(row for batch in batches for at in range(0, batch.num_rows, 256) for row in batch.slice(at, 256).to_pylist()), arrow)

    return df.mapInArrow(run, kind)


def _runs(rows: Iterator[dict]) -> Iterator[dict]:
    """Rows of one range in order: closed conversations, and open runs where one may go on beyond the range or the limits."""
    now: Run | None = None
    part = run = 0
    opened = True  # the conversation may have begun before this run
    for row in rows:
        part = row["part"]
        if now is None or now.conv_id != row["conv_id"]:
            if now is not None:
                yield now.result(part, run, not opened)
                run, opened = run + 1, False
            now = Run(row["conv_id"])
        elif len(now.rows) >= RUN_ROWS or now.size >= RUN_BYTES:
            yield now.result(part, run, False)
            run, opened, now = run + 1, True, Run(row["conv_id"])
        if not row["dropped"]:
            now.add(row["turn"], row["role"], row["text"], row["copies"], row["first"])
    if now is not None:
        yield now.result(part, run, False)


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
JOINED = RESULT + ", split boolean"


def _joined(runs: Iterator[dict]) -> Iterator[dict]:
    """Conversations out of their runs, in order; ``split`` where the digest is still to be made."""

    def close(group: dict) -> dict:
        out = {"conv_id": group["conv_id"], **{k: group[k] for k in COUNTS if k != "turns"}}
        out["gaps"] = group["high"] - group["low"] + 1 - group["turns"] if group["low"] is not None else 0
        if group["runs"] == 1:
            return out | {"split": False} | {k: group[k] for k in ("cost", "audit", "repaired_sha256")}
        cost, audit = finish(group["cells"])
        return out | {"split": True, "cost": cost, "audit": audit.decode(), "repaired_sha256": None}

    group: dict | None = None
    for r in runs:
        if group is None or group["conv_id"] != r["conv_id"]:
            if group is not None:
                yield close(group)
            group = r | {"runs": 0, "cells": {START: (0, Trail(None, b""))}}
        else:
            for k in COUNTS:
                group[k] += r[k]
            if group["n"] and r["n"]:
                group["illegal"] += (group["last_role"] + r["first_role"]).encode() not in LEGAL
            if r["low"] is not None:
                group["turns"] -= group["high"] == r["low"]
                group["low"] = r["low"] if group["low"] is None else group["low"]
                group["high"] = r["high"]
            group["last_role"] = r["last_role"] if r["n"] else group["last_role"]
            group["n"] += r["n"]
        group["runs"] += 1
        if r["n"] and r["costs"]:
            edges = [(k // 4, k % 4, c, a) for k, (c, a) in enumerate(zip(r["costs"], r["audits"], strict=True)) if c is not None]
            group["cells"] = advance(group["cells"], edges)
    if group is not None:
        yield close(group)


def _digests(rows: Iterator[dict]) -> Iterator[dict]:
    """A stream of (conversation, its audit first, then its rows) to digests, row by row."""
    ahead = next(rows, None)
    while ahead is not None:
        conv_id, audit = ahead["conv_id"], ahead["text"]

        def body(conv_id: int | None = conv_id) -> Iterator[tuple[bytes, bytes, int]]:
            nonlocal ahead
            while (ahead := next(rows, None)) is not None and ahead["conv_id"] == conv_id:
                if not ahead["dropped"]:
                    yield ahead["role"], ahead["text"], ahead["copies"]

        lines = body()
        digest = digest_of(repaired(audit, lines))
        for _ in lines:  # read to the conversation's end
            pass
        yield {"conv_id": conv_id, "digest": digest}


def damaged(conversations: DataFrame) -> DataFrame:
    """The damaged table: conv_id, turn, role, text, copies, and one row ``dropped`` for what was dropped."""
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    shown = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown(conv), F.lit(":"), shown(turn)).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind"))
    live = lambda c: F.when(F.col("kind") != 0, c)
    return rows.select(
        "conv_id",
        (F.col("kind") == 0).alias("dropped"),
        live(F.col("turn")).alias("turn"),
        live(F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))).alias("role"),
        live(F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def undamaged(conversations: DataFrame) -> DataFrame:
    """The table as it is, in the form of ``damaged``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    conv, turn = (F.col(c).cast("long").alias(c) for c in ("conv_id", "turn"))
    return conversations.select(conv, F.lit(False).alias("dropped"), turn, role, text, F.lit(1).cast("long").alias("copies"))


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, fault counts, cost, audit, repaired_sha256 of every conversation in ``rows`` (see ``damaged``)."""
    keys = ["conv_id", "dropped", "turn", "role", "text"]
    once = rows.groupBy(*keys).agg(F.sum("copies").alias("copies"))
    order = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    firsts = once.where("not dropped").groupBy("conv_id", "role", "text").agg(F.min(order).alias("t"))
    firsts = firsts.select("conv_id", F.col("t.turn").alias("turn"), "role", "text", F.lit(True).alias("first")).alias("f")
    on: Column = functools.reduce(
        lambda x, y: x & y, [F.col(f"o.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("conv_id", "turn", "role", "text")]
    )
    marked = once.alias("o").join(firsts, on, "left").select(
        *(F.col(f"o.{c}") for c in (*keys, "copies")), F.coalesce("first", F.lit(False)).alias("first")
    )
    marked = marked.withColumn("role", F.col("role").cast("binary")).withColumn("text", F.col("text").cast("binary"))
    marked = settle(marked, "marked")
    order_by = [F.col("conv_id"), F.col("dropped").desc(), F.col("turn"), F.col("role"), F.col("text")]
    ranged = marked.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    ranged = ranged.withColumn("part", F.spark_partition_id().cast("long"))
    runs = settle(_stream(ranged, _runs, RUN), "runs")
    done = runs.where("whole").select(
        "conv_id", (F.coalesce(F.col("high") - F.col("low") + 1, F.lit(0)) - F.col("turns")).alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256",
    )
    parts = runs.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "run")
    joined = settle(_stream(parts, _joined, JOINED), "joined")
    split = joined.where("split")
    if not split.isEmpty():
        wanted = split.select(F.col("conv_id").alias("c"))
        body = marked.join(wanted, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
        body = body.select("conv_id", F.lit(1).alias("kind"), "dropped", "turn", "role", "text", "copies")
        head = split.select(
            "conv_id", F.lit(0).alias("kind"), F.lit(True).alias("dropped"), F.lit(None).cast("long").alias("turn"),
            F.lit(b"").alias("role"), F.col("audit").cast("binary").alias("text"), F.lit(0).cast("long").alias("copies"),
        )
        feed = head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *order_by[1:])
        made = _stream(feed, _digests, "conv_id long, digest string").alias("m")
        joined = joined.alias("j").join(made, F.col("j.conv_id").eqNullSafe(F.col("m.conv_id")), "left").select(
            *(F.col(f"j.{c}") for c in joined.columns if c != "repaired_sha256"), F.coalesce("repaired_sha256", "digest").alias("repaired_sha256")
        )
    return done.unionByName(joined.select(*done.columns))
