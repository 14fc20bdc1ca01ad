"""Near-duplicate groups of SimHash fingerprints by vantage-point trees.

Fingerprint: XXH64 (seed 42) of every shingle, repeats included; a bit is 1 where over half of the hashes have it.  Two
fingerprints link at ``RADIUS`` or fewer differing bits.  Equal fingerprints are one node.

A tree over a bounded sample of the distinct fingerprints gives the shards: an inner node splits by the Hamming distance
to its vantage point at ``limit`` (inside: at most ``limit``).  Every fingerprint has one home leaf.  By the triangle
inequality a link from inside to outside has its outer end at most ``limit + RADIUS`` from the vantage point, so only those
boundary fingerprints are sent inside as guests, and guests follow both branches where the triangle bounds overlap.  Each
link thus meets in exactly one leaf, as home with home or home with guest.  Within a leaf the same splits go on
(``self_links``, ``cross_links``) until blocks are small, which are compared bit by bit.  The search is exact.

A leaf holds about ``LEAF`` home fingerprints whatever the corpus holds: the sample grows with the number of leaves
(``A_LEAF`` each) and copies count once.  Guests stream past the homes in blocks.  A leaf reports a spanning forest of its links, so
a dense group costs rows in proportion to its members.  In 64 dimensions distances concentrate, so each level of the tree sends
a good quarter of its fingerprints to both sides: the price of this method, stated in the README.

Defined results: null text is empty; a text without words has fingerprint zero, linked like any other.  Rows that repeat a
doc_id count as one node.  A null doc_id stays alone (component null).  An empty table gives an empty result, other
columns of the input are ignored.  Very long texts are hashed in blocks of ``BLOCK`` shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohorta.llm.common import column, map_batches, space_words, text_table
from kohorta.llm.near_dup import components
from kohorta.session import settle

RADIUS = 3
SEED = 42
LEAF = 4096  # home fingerprints of a leaf, about
A_LEAF = 32  # sampled fingerprints a leaf
SMALL = 1 << 18  # pairs compared at once
GUESTS = 1 << 14  # guests compared with the homes at a time
BLOCK = 1 << 14  # shingles turned to bits at a time


def fingerprint(words: list[bytes], n: int = 3) -> int:
    """The SimHash of the n-word shingles (fewer words: of the whole sequence; none: 0)."""
    if not words:
        return 0
    n = min(n, len(words))
    total, ones = len(words) - n + 1, np.zeros(64, np.int64)
    for at in range(0, total, BLOCK):
        part = words[at : min(at + BLOCK, total) + n - 1]
        hashes = [xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(part[k:] for k in range(n)), strict=False)]
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every row."""

    def run(batch: pa.RecordBatch) -> dict:
        found = np.array([fingerprint(space_words(t), words) for t in column(batch, "text")], np.uint64)
        return {"doc_id": column(batch, "doc_id"), "fp": found.view(np.int64)}

    return map_batches(docs, run, "doc_id long, fp long")


def far(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int64)


def _split(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """A vantage point and the limit that halves the points; None where all distances but its own are equal.

    Of a few points the one whose halves leave least at the boundary is taken.
    """
    best = None
    for vantage in points[:: max(1, len(points) // 5)][:5]:
        d = far(points, vantage)
        limit = int(np.median(d))
        for t in (limit - 1, limit):
            inside = int((d <= t).sum())
            if 0 < inside < len(points):
                worth = (abs(2 * inside - len(points)) // 8 + int(((d > t) & (d <= t + RADIUS)).sum()), int(vantage), t)
                best = worth if best is None else min(best, worth)
    return None if best is None else (np.uint64(best[1]), best[2])


def build(sample: np.ndarray, leaves: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Inner nodes (vantage, limit, inside, outside) of a tree with at most ``leaves`` leaves, and their number.

    A child is the position of an inner node, or -1 - leaf.
    """
    nodes: list[tuple[int, int, int, int]] = []
    count = 0

    def grow(points: np.ndarray, wanted: int) -> int:
        nonlocal count
        cut = _split(points) if wanted > 1 and len(points) > 1 else None
        if cut is None:
            count += 1
            return -count
        at = len(nodes)
        nodes.append((0, 0, 0, 0))
        near = far(points, cut[0]) <= cut[1]
        less = wanted // 2
        inner, outer = grow(points[near], less), grow(points[~near], wanted - less)
        nodes[at] = (int(cut[0]), cut[1], inner, outer)
        return at

    grow(sample, leaves)
    return nodes, count


def route(nodes: list[tuple[int, int, int, int]], points: np.ndarray) -> Iterator[tuple[int, bool, np.ndarray]]:
    """(leaf, home, points) for each leaf that the points reach, as homes or as guests."""
    todo = [(0 if nodes else -1, points, points[:0])]
    while todo:
        at, homes, guests = todo.pop()
        if at < 0:
            for home, group in ((True, homes), (False, guests)):
                if len(group):
                    yield -1 - at, home, group
            continue
        vantage, limit, inner, outer = nodes[at]
        dh, dg = far(homes, np.uint64(vantage)), far(guests, np.uint64(vantage))
        boundary = homes[(dh > limit) & (dh <= limit + RADIUS)]
        inside = homes[dh <= limit], np.concatenate((guests[dg <= limit + RADIUS], boundary))
        outside = homes[dh > limit], guests[dg > limit - RADIUS]
        for child, (h, g) in ((inner, inside), (outer, outside)):
            if len(h) or len(g):
                todo.append((child, h, g))


def cross_links(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of two sets of fingerprints."""
    todo = [(left, right)]
    while todo:
        a, b = todo.pop()
        if not len(a) or not len(b):
            continue
        cut = _split(a) if len(a) * len(b) > SMALL and len(a) > 64 else None
        if cut is None:
            step = max(1, SMALL // len(b))
            for k in range(0, len(a), step):
                x, y = np.nonzero(np.bitwise_count(a[k : k + step, None] ^ b[None, :]) <= RADIUS)
                if len(x):
                    yield a[k + x], b[y]
            continue
        da, db = far(a, cut[0]), far(b, cut[0])
        todo.append((a[da <= cut[1]], b[db <= cut[1] + RADIUS]))
        todo.append((a[da > cut[1]], b[db > cut[1] - RADIUS]))


def self_links(points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs within a set of distinct fingerprints; a pair may come both ways."""
    todo = [points]
    while todo:
        p = todo.pop()
        cut = _split(p) if len(p) * len(p) > SMALL else None
        if cut is None:
            yield from cross_links(p, p)
            continue
        d = far(p, cut[0])
        todo += [p[d <= cut[1]], p[d > cut[1]]]
        yield from cross_links(p[d <= cut[1]], p[(d > cut[1]) & (d <= cut[1] + RADIUS)])


class Forest:
    """Links of one leaf joined to a spanning forest."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent, top = self.parent, x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.view(np.int64).tolist(), b.view(np.int64).tolist(), strict=True):
            if x != y:
                x, y = self.root(x), self.root(y)
                self.parent[max(x, y)] = min(x, y)

    def edges(self) -> list[tuple[int, int]]:
        return [(x, self.root(x)) for x in list(self.parent) if self.root(x) != x]


def leaf_links(shards: DataFrame) -> DataFrame:
    """(a, b) of a spanning forest of the links of each leaf; ``shards``: leaf, home, fp, sorted so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, homes, guests, forest = None, [], [], Forest()
        held: np.ndarray | None = None

        def meet() -> None:
            nonlocal held, guests
            if held is None:
                held = np.concatenate(homes) if homes else np.empty(0, np.uint64)
                for a, b in self_links(held):
                    forest.add(a, b)
            if guests:
                for a, b in cross_links(held, np.concatenate(guests)):
                    forest.add(a, b)
                guests = []

        def close() -> pa.RecordBatch:
            meet()
            edges = forest.edges()
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            ids, kind = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            fps = batch.column(2).to_numpy().view(np.uint64)
            key = ids.astype(np.int64) * 2 + (1 - kind.astype(np.int64))
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True):
                if ids[s] != leaf:
                    if leaf is not None:
                        yield close()
                    leaf, homes, guests, forest, held = ids[s], [], [], Forest(), None
                if kind[s]:
                    homes.append(fps[s:e])
                else:
                    guests.append(fps[s:e])
                    if sum(map(len, guests)) > GUESTS:
                        meet()
        if leaf is not None:
            yield close()

    return shards.mapInArrow(run, "a long, b long")


def fingerprint_links(points: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(a, b) of a spanning forest per leaf of the links among distinct fingerprints ``fp``."""
    leaves = -(-points.count() // leaf)
    sample = [r.fp for r in points.orderBy(F.xxhash64("fp"), "fp").limit(leaves * A_LEAF).collect()] if leaves > 1 else []
    nodes, _ = build(np.array(sample, np.int64).view(np.uint64), leaves)
    tree = points.sparkSession.sparkContext.broadcast(nodes)

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"leaf": [], "home": [], "fp": []}
        for at, home, group in route(tree.value, batch.column(0).to_numpy().view(np.uint64)):
            out["leaf"].append(np.full(len(group), at, np.int64))
            out["home"].append(np.full(len(group), home))
            out["fp"].append(group.view(np.int64))
        return {k: np.concatenate(v) for k, v in out.items()}

    shards = map_batches(points, run, "leaf long, home boolean, fp long")
    return leaf_links(shards.repartition("leaf").sortWithinPartitions("leaf", F.col("home").desc(), "fp"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable) of every row."""
    rows = settle(fingerprints(text_table(docs, id_col, text_col), words), "fingerprints")
    real = rows.where("doc_id is not null")
    points = settle(real.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    several = real.groupBy("doc_id").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top").select("doc_id", "b")
    tied = real.join(several, "doc_id").select(F.col("fp").alias("a"), "b").where("a <> b")
    comps = components(fingerprint_links(points.select("fp")).unionAll(tied), "fingerprint-groups")
    placed = points.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = settle(placed.join(least, "root").select("fp", "component_id"), "placed")
    out = rows.join(named, "fp", "left")
    return out.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
