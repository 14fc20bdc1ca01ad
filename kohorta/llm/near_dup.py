"""Near-duplicate groups by fast similarity sketches, banding and exact verification.

Method (Dahlgaard, Knudsen, Thorup: fast similarity sketching).  A sketch has ``BINS`` coordinates.  In round i
every shingle falls into one hashed bin with the value (i, hash); a bin keeps its least value.  After ``BINS``
hashed rounds, round BINS + j places every shingle in bin j, so each coordinate is filled; a set that fills all
bins early stops early.  The values of an early round are below those of a later one, so stopping changes nothing.

Banding: ``BINS / ROWS`` bands of ``ROWS`` coordinates.  A pair of similarity 0.8 agrees in no band with
probability (1 - 0.8**4)**32, about 5e-8.  Candidates are confirmed on the full shingle sets.

Work on a group of similar texts stays linear.  Equal sets form one class with one representative.  Inside a band
bucket, representatives are first compared with one hub; once the links found are joined to components, only
buckets that still hold several components are compared further: in all pairs across components where these are few
for the bucket's size (finer sketches, compared in blocks inside a task, that agree in fewer than ``ALIKE`` coordinates need no
look at the texts; likest partners are confirmed first, and what their links join needs no further look; where members still
have unnamed partners, their whole sets, or samples of large ones, are compared inside the task and only what these do not
rule out is named, so that no row is made per pair of a group that is merely alike), else with
a further hub, then after splitting the members of all such buckets by the bands of a second, independent sketch (as many as the first has), then by 128
bands of ``DEEP_ROWS`` coordinates of a third.  A pair of similarity 0.8 shares no band of the second with probability
5e-8 and none of the third with probability 6e-11, whatever number of first bands it shares.  What is still
large is compared hub by hub until nothing is left to compare.  No bucket is cut off.  A task that confirms pairs
remembers the sets it made, up to ``REMEMBERED``, since most pairs of a group meet the same texts again; components
carry over from round to round, so that a round adds only the links that cross them.

Defined results: null text is empty; an empty set is linked with nothing and its component is the document itself.
Rows that repeat a doc_id count as one node.  A null doc_id stays alone (component null, kept).  Other columns of
the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohorta.llm.common import column, map_batches, mix, shingle_set, space_words, text_table
from kohorta.session import settle, text_batches

BINS = 128
ROWS = 4
FINE = 4  # sketches of BINS coordinates, 8 bits each, by which the pairs of a bucket are sieved
ALIKE = 350  # of the FINE * BINS coordinates shared; at similarity 0.8 fewer have probability 2e-10
PAIRS_A_ROW = 2048  # a bucket with no more pairs across components than this per member is compared in full
CHUNK = 1024  # members, at least, that one task compares with those outside the bucket's largest component
ONE_TASK = 1 << 18  # edges of a graph that one task joins up
LIKEST = (16, None)  # partners a member names in the rounds of a bucket; the last, where some are left, names all
HUBS = 2  # hubs tried at each depth before a bucket is split
DEEP = 3  # splits by first, second and third bands; what is large after the last is compared hub by hub
DEEP_ROWS = 8  # coordinates of a third band
SAMPLE = 1024  # hashes of a set that a bucket's last round compares; smaller sets are compared as a whole
SPREAD = 6.6  # standard deviations below ``percent`` at which a sample rules a pair out (2e-10 at 0.8)
REMEMBERED = 1 << 21  # 8-byte words of texts and sets that a task keeps while it confirms pairs
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(BINS - 1)


def sketch(shingles: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The fast similarity sketch of a non-empty set of 64-bit hashes (``bins`` a power of two, 2**7 at most)."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(bins, empty, np.uint64)
    size, at = len(shingles), 0
    step = max(1, min(bins, 4 * bins // size + 1))
    while at < bins:
        rounds = np.arange(at, min(at + step, bins), dtype=np.uint64)
        at += step
        drawn = mix(shingles[None, :] + (rounds * _GOLD)[:, None])
        value = (drawn >> np.uint64(8)) | (rounds << np.uint64(56))[:, None]
        np.minimum.at(out, (drawn & np.uint64(bins - 1)).astype(np.int64).ravel(), value.ravel())
        if out.max() != empty:
            return out
    late = np.arange(bins, 2 * bins, dtype=np.uint64)
    for j in np.flatnonzero(out == empty):
        out[j] = (mix(shingles + late[j : j + 1] * _GOLD) >> np.uint64(8)).min() | (late[j] << np.uint64(56))
    return out


def band_keys(values: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band of a sketch, different bands never sharing a key."""
    values = values.reshape(-1, rows)
    key = mix(np.arange(len(values), dtype=np.uint64) * _GOLD)
    for r in range(rows):
        key = mix(key * np.uint64(31) + values[:, r])
    return key.view(np.int64)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set and band keys (null if empty)."""

    def run(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(space_words(t), words) for t in column(batch, "text")]
        drawn = [sketch(s) if len(s) else None for s in sets]
        return {
            "doc_id": column(batch, "doc_id"),
            "n_shingles": [len(s) for s in sets],
            "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
            "bands": [None if v is None else band_keys(v) for v in drawn],
        }

    return map_batches(docs, run, "doc_id long, n_shingles long, digest binary, bands array<long>")


def fine_sketches(texts: DataFrame, words: int) -> DataFrame:
    """node, short: ``FINE`` independent sketches per document, size: of its set; null where rows of one doc_id differ."""

    def short(found: np.ndarray) -> bytes | None:
        seeds = mix(np.arange(1, FINE + 1, dtype=np.uint64))
        return b"".join(mix(sketch(mix(found ^ seed))).astype(np.uint8).tobytes() for seed in seeds) if len(found) else None

    def run(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(space_words(t), words) for t in column(batch, "text")]
        return {"node": column(batch, "doc_id"), "short": [short(s) for s in sets], "size": [len(s) for s in sets]}

    drawn = map_batches(texts, run, "node long, short binary, size long")
    same = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).alias(c)
    return drawn.groupBy("node").agg(same("short"), same("size"))


def set_samples(texts: DataFrame, words: int) -> DataFrame:
    """node, sample: leading 32 bits of the set's hashes below 2**(64 - level), sorted, about ``SAMPLE`` at most (level 0: the
    whole set), level; null where rows of one doc_id differ."""

    def one(found: np.ndarray) -> tuple[bytes, int]:
        level = max(0, (len(found) - 1) // SAMPLE).bit_length()
        if level:
            found = found[: np.searchsorted(found, np.uint64(1 << (64 - level)))]
        return (found >> np.uint64(32)).astype(np.uint32).tobytes(), level

    def run(batch: pa.RecordBatch) -> dict:
        drawn = [one(shingle_set(space_words(t), words)) for t in column(batch, "text")]
        return {"node": column(batch, "doc_id"), "sample": [d[0] for d in drawn], "level": [d[1] for d in drawn]}

    drawn = map_batches(texts, run, "node long, sample binary, level int")
    same = F.min("sample") == F.max("sample")
    return drawn.groupBy("node").agg(F.when(same, F.min("sample")).alias("sample"), F.min("level").alias("level"))


def _by_samples(mine: list, part: list, percent: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """Tells which members of ``part`` (sample, level) may be linked with member i of ``mine``: for whole sets an exact look."""
    known = np.unique(np.concatenate([v for v, _ in mine + part]))
    ids = [np.searchsorted(known, v) for v, _ in part]
    table = np.full((len(part), max(map(len, ids))), len(known))  # filled up with a hash that none holds
    for row, found in zip(table, ids, strict=True):
        row[: len(found)] = found
    levels, marks, share = np.array([at for _, at in part]), np.zeros(len(known) + 1, bool), percent / 100

    def may(i: int, rows: np.ndarray) -> np.ndarray:
        own, here = np.searchsorted(known, mine[i][0]), table[rows]
        marks[own] = True
        at = np.maximum(levels[rows], mine[i][1])  # the coarser of both samples
        bound = np.searchsorted(known, 1 << (32 - at))
        low = here < bound[:, None]
        shared = (marks[here] & low).sum(axis=1)
        marks[own] = False
        union = (own[None, :] < bound[:, None]).sum(axis=1) + low.sum(axis=1) - shared
        slack = 2 + SPREAD * np.sqrt(share * (1 - share) * union) * (at > 0)  # 2: hashes of one set that share 32 bits
        return shared + slack >= share * union

    return may


def deep_bands(texts: DataFrame, words: int) -> DataFrame:
    """node, second, third: keys of the bands by which large buckets are split, from sketches independent of the others."""
    seeds = mix(np.arange(FINE + 1, FINE + DEEP_ROWS + 2, dtype=np.uint64))

    def keys(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        drawn = [sketch(mix(found ^ seed)) for seed in seeds]
        return band_keys(drawn[0]), band_keys(np.concatenate(drawn[1:]), DEEP_ROWS)

    def run(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(space_words(t), words) for t in column(batch, "text")]
        both = [keys(s) if len(s) else (None, None) for s in sets]
        return {"node": column(batch, "doc_id"), "second": [b[0] for b in both], "third": [b[1] for b in both]}

    drawn = map_batches(texts, run, "node long, second array<long>, third array<long>")
    return drawn.groupBy("node").agg(*(F.flatten(F.collect_set(c)).alias(c) for c in ("second", "third")))


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets hold 100 * |intersection| >= percent * |union|."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[bytes, np.ndarray] = {}
        held = 0

        def shingles(text: bytes) -> np.ndarray:
            nonlocal held
            known = sets.get(text)
            if known is None:
                if held > REMEMBERED:
                    sets.clear()
                    held = 0
                known = sets[text] = shingle_set(space_words(text), words)
                held += len(known) + len(text) // 8
            return known

        for batch in batches:
            linked = []
            for ta, tb in zip(column(batch, "text_a"), column(batch, "text_b"), strict=True):
                one, other = shingles(ta), shingles(tb)
                least, most = sorted((len(one), len(other)))
                both = 0
                if 100 * least >= percent * most:
                    both = len(np.intersect1d(one, other, assume_unique=True))
                linked.append(100 * both >= percent * (least + most - both))
            keep = pa.array(linked, pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    joined = pairs.join(right, "b").join(left, "a")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root of a graph that one task can hold."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        way = []
        while (up := parent.setdefault(x, x)) != x:
            way.append(x)
            x = up
        for w in way:
            parent[w] = x
        return x

    for batch in batches:
        for a, b in zip(column(batch, "a"), column(batch, "b"), strict=True):
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(top, nodes), pa.int64())], ["node", "root"])


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, root (least node reachable) for the nodes of undirected ``edges`` (a, b).

    Alternates "large star" and "small star" (Kiveris et al. 2014): each node's larger neighbours, then its
    smaller ones, are tied to its least neighbour, until nothing changes.  Rounds grow with the logarithm of
    the graph's size; neighbourhoods are aggregated, never gathered.  A graph of at most ``ONE_TASK`` edges needs no rounds: one
    task joins it up, with the same result.
    """
    edges = settle(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), label
    )
    if edges.count() <= ONE_TASK:
        return settle(edges.coalesce(1).mapInArrow(_join_up, "node long, root long"), label)
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(low, "a")
        small = tied.select(F.col("a"), F.col("m").alias("b")).unionAll(
            tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        after = settle(small.distinct(), label)
        stars = after.groupBy("a").count().where("count > 1").unionAll(
            after.join(after.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a", F.lit(0))
        )
        edges = after
        if stars.isEmpty():
            break
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _hub_pairs(members: DataFrame, seed: int) -> DataFrame:
    """(hub, member) of each bucket; the hub is the first member in an order hashed with ``seed``."""
    order = F.struct(F.xxhash64("key", "node", F.lit(seed)).alias("o"), F.col("node"))
    hubs = members.groupBy("key").agg(F.min(order).getField("node").alias("a"))
    return _pairs(members.join(hubs, "key").select("a", F.col("node").alias("b")))


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _by_node(members: DataFrame, *fields: str) -> DataFrame:
    """node, places: a node's buckets in one row, so that what is known of it is joined once; no more than its bands."""
    return members.groupBy("node").agg(F.collect_list(F.struct(*fields)).alias("places"))


def _each_place(nodes: DataFrame) -> DataFrame:
    """A row per bucket again; the other columns are repeated."""
    return nodes.select("*", F.explode("places").alias("place_")).select("*", "place_.*").drop("places", "place_")


def _placed(nodes: DataFrame, comps: DataFrame) -> DataFrame:
    """Members, given by node, with their component as it is now."""
    known = nodes.select("node", "places").join(comps, "node", "left")
    return _each_place(known.withColumn("root", F.coalesce("root", "node")))


def _open(known: DataFrame) -> DataFrame:
    """Members of buckets that hold several components; n rows, ``crossing`` pairs across components."""
    parts = known.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    sizes = parts.groupBy("key").agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq"), F.max(F.struct("c", "root")).alias("most")
    )
    crossing = ((F.col("n") * F.col("n") - F.col("sq")) / 2).alias("crossing")
    chunks = F.ceil(F.col("n") / F.greatest(F.lit(CHUNK), F.col("n") - F.col("most.c"))).cast("int").alias("chunks")
    wide = sizes.where("sq < n * n").select("key", "n", F.col("most.root").alias("top"), crossing, chunks)
    return known.join(wide, "key")


def _across(members: DataFrame, percent: int, most: int | None) -> DataFrame:
    """(a, b) of different components whose sketches agree in ``ALIKE`` coordinates, or whose ``sample`` allows a link where
    members have one; each has a member outside the bucket's largest component, and each such member names its ``most``
    likest partners of a block (None: all).  Where some are left unnamed, a row holds the bucket's ``key`` alone.

    Sketches or samples are compared in blocks inside the task, so no row is made per pair looked at.  Members of a bucket are dealt
    over chunks of ``CHUNK`` or as many as are outside the largest component, and these (``minor``, at most twice
    ``PAIRS_A_ROW`` by the limit on pairs) go to every chunk: rows are at most about twice the bucket's.  A pair whose set
    sizes rule the link out is skipped, and of the buckets of one depth that two members share only that of their least
    bands forms it (``earlier``: a member's other bands below the bucket's last).
    """
    sampled = "sample" in members.columns
    fields = ["node", "root", "short", "size", "earlier", *(["sample", "level"] if sampled else [])]
    askers = members.where("minor").select(
        "key", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("side"), "minor", *fields
    )
    others = members.select("key", F.pmod(F.xxhash64("node"), "chunks").cast("int").alias("chunk"), F.lit(1).alias("side"), "minor", *fields)
    dealt = askers.unionByName(others).repartition("key", "chunk").sortWithinPartitions("key", "chunk", "side")

    def meet(mine: dict, part: dict) -> tuple[list, list, bool]:
        """Pairs of the askers with one block of the others, and whether some were left unnamed."""
        a, b, more = [], [], False
        may = _by_samples(mine["sample"], part["sample"], percent) if sampled else None
        for i, node in enumerate(mine["node"]):
            fit = part["root"] != mine["root"][i]
            fit &= ~part["minor"] | (part["node"] > node)
            if mine["size"][i] >= 0:
                low, high = np.minimum(part["size"], mine["size"][i]), np.maximum(part["size"], mine["size"][i])
                fit &= (part["size"] < 0) | (100 * low >= percent * high)
            at = np.flatnonzero(fit)
            agree = (part["short"][at] == mine["short"][i]).sum(axis=1)
            unknown = (part["size"][at] < 0) | (mine["size"][i] < 0)  # the texts decide
            agree[unknown] = FINE * BINS
            good = np.flatnonzero(agree >= ALIKE)
            if may and len(good):
                good = good[unknown[good] | may(i, at[good])]
            left = most or len(good)
            for j in at[good[np.argsort(-agree[good], kind="stable")]].tolist():
                if not mine["earlier"][i].isdisjoint(part["earlier"][j]):
                    continue
                if not left:
                    more = True
                    break
                a.append(int(node))
                b.append(int(part["node"][j]))
                left -= 1
        return a, b, more

    def block(batch: pa.RecordBatch) -> dict:
        short = column(batch, "short")
        size = [-1 if v is None or s is None else v for v, s in zip(column(batch, "size"), short, strict=True)]
        look = {}
        if sampled:
            drawn = column(batch, "sample")
            size = [-1 if s is None else v for v, s in zip(size, drawn, strict=True)]
            look["sample"] = [(np.frombuffer(s or b"", np.uint32), at) for s, at in zip(drawn, column(batch, "level"), strict=True)]
        return look | {
            "node": np.array(column(batch, "node"), np.int64), "root": np.array(column(batch, "root"), np.int64),
            "minor": np.array(column(batch, "minor"), bool),
            "short": np.frombuffer(b"".join(v or bytes(FINE * BINS) for v in short), np.uint8).reshape(-1, FINE * BINS),
            "size": np.array(size, np.int64), "earlier": [frozenset(v) for v in column(batch, "earlier")],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, mine = None, None
        for batch in batches:
            key, chunk, side = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            turn = np.flatnonzero((key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1]) | (side[1:] != side[:-1])) + 1
            for s, e in zip([0, *turn.tolist()], [*turn.tolist(), len(key)], strict=True):
                part = block(batch.slice(s, e - s))
                if side[s] == 0:
                    if here == (key[s], chunk[s]):
                        part = {k: [*mine[k], *v] if isinstance(v, list) else np.concatenate((mine[k], v)) for k, v in part.items()}
                    here, mine = (key[s], chunk[s]), part
                elif here == (key[s], chunk[s]):
                    a, b, more = meet(mine, part)
                    keys = [None] * len(a)
                    if more:
                        a, b, keys = [*a, None], [*b, None], [*keys, int(key[s])]
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (a, b, keys)], ["a", "b", "key"])

    return dealt.mapInArrow(run, "a long, b long, key long")


def _deeper(members: DataFrame, deep: DataFrame, depth: int) -> DataFrame:
    """Members of large buckets, each dealt once to sub-buckets by its second or third bands.

    Large buckets of one group hold much the same members, so the members of all are dealt together, not bucket by
    bucket.  ``path`` is 0 and the second band, or 0, the third band and 0.
    """
    zero = F.lit(0).cast("long")
    ends = [zero, F.col("next")] if depth == 2 else [zero, F.col("next"), zero]
    dealt = members.select("node", "root").distinct().join(deep, "node").select(
        "node", "root", F.explode(F.array_distinct("second" if depth == 2 else "third")).alias("next")
    )
    return dealt.select(F.xxhash64(F.lit(depth), "next").alias("key"), "node", F.array(*ends).alias("path"), "root")


def _sketched(members: DataFrame, fine: DataFrame, deep: DataFrame | None) -> DataFrame:
    """One row per node of the members: its sketches and all its bands."""
    nodes = members.select("node").distinct().join(fine, "node")
    return nodes if deep is None else nodes.join(deep, "node", "left")


def _rooms(nodes: DataFrame, opened: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of the ``opened`` buckets with their component as it is now, their sketches and ``earlier``, the bands below
    those of their path: two members that share one meet in its bucket too.  ``minor`` is as of the opening: components
    only grow together, so of two members still apart one was outside the largest then."""
    places = _by_node(opened, "key", "path", "minor", "chunks").join(comps, "node", "left")
    members = _each_place(nodes.join(places.withColumn("root", F.coalesce("root", "node")), "node"))
    lower = lambda name, at: F.filter(name, lambda b: b < F.element_at("path", at))
    earlier, depth = lower("bands", 1), F.size("path")
    if "second" in nodes.columns:
        earlier = F.when(depth == 1, earlier).when(depth == 2, lower("second", 2)).when(depth == 3, lower("third", 2))
        earlier = F.coalesce(earlier, F.array().cast("array<long>"))
    return members.withColumn("earlier", earlier).drop("bands", "second", "third", "path")


def _shared(members: DataFrame) -> DataFrame:
    """Members of buckets with two members or more."""
    return members.join(members.groupBy("key").count().where("count > 1").select("key"), "key", "left_semi")


def _rooted(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components."""
    side = lambda n, r: comps.select(F.col("node").alias(n), F.col("root").alias(r))
    known = pairs.join(side("a", "ra"), "a", "left").join(side("b", "rb"), "b", "left")
    return known.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).drop("ra", "rb")


def links(bands: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """node, root of the representatives (node, bands) that confirmed links join."""
    members = settle(
        _shared(bands.select("node", F.explode("bands").alias("key"))).withColumn("path", F.array("key")), "bucket"
    )
    held = texts.join(members.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    held = settle(held, "candidate-texts")
    fine = deep = None

    def join_up(pairs: DataFrame, comps: DataFrame) -> DataFrame:
        found = settle(_rooted(confirm(pairs, held, words, percent), comps), "links")
        if found.isEmpty():
            return comps
        return components(found.unionAll(comps.select(F.col("node").alias("a"), F.col("root").alias("b"))), "roots")

    tried = settle(_hub_pairs(members, 0), "tried")
    comps = components(confirm(tried, held, words, percent), "roots")
    depth, seed, hubs = 1, 0, 1
    small = F.col("crossing") <= PAIRS_A_ROW * F.col("n")
    while not members.isEmpty():
        left = settle(_open(_placed(_by_node(members, "key", "path"), comps)), "open")
        near, members = left.where(small), left.where(~small)
        if hubs >= HUBS and depth < DEEP:
            depth, hubs = depth + 1, 0
            if deep is None:
                large = members.select(F.col("node").alias("doc_id")).distinct()
                deep = settle(deep_bands(held.join(large, "doc_id", "left_semi"), words), "deep-bands")
            left = settle(_open(_deeper(members, deep, depth)), "deeper")
            near, members = near.unionByName(left.where(small)), left.where(~small)
        if fine is None:
            fine = settle(fine_sketches(held, words).join(bands, "node"), "fine")
        seed, hubs = seed + 1, hubs + 1
        near = settle(near.withColumn("minor", F.col("root") != F.col("top")).drop("root", "top", "n", "crossing"), "rooms")
        nodes = settle(_sketched(near, fine, deep), "near")
        for most in LIKEST:
            named = settle(_across(_rooms(nodes, near, comps), percent, most), "named")
            wanted = _pairs(named.where("key is null"))
            if most == LIKEST[0]:
                wanted = wanted.unionAll(_hub_pairs(members, seed)).distinct()
            fresh = settle(wanted.join(tried, ["a", "b"], "left_anti"), "tried")
            tried = tried.unionAll(fresh)
            comps = join_up(fresh, comps)
            near = near.join(named.select("key").where("key is not null").distinct(), "key", "left_semi")
            if near.isEmpty():  # every pair of these buckets was named
                break
            if most is not None:
                near = settle(near, "rooms")
                again = held.join(near.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
                nodes = settle(nodes.join(set_samples(again, words), "node"), "samples")
        if depth == DEEP:  # a hub that was compared with all of its bucket leaves it
            order = F.struct(F.xxhash64("key", "node", F.lit(seed)).alias("o"), F.col("node"))
            done = members.groupBy("key").agg(F.min(order).getField("node").alias("node"))
            members = members.join(done, ["key", "node"], "left_anti")
    return comps


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; see the module for the method and defined results."""
    with text_batches(docs.sparkSession):
        return _grouped(text_table(docs, id_col, text_col), words, percent)


def _grouped(table: DataFrame, words: int, percent: int) -> DataFrame:
    rows = settle(signatures(table, words), "signatures")
    real = rows.where("digest is not null and doc_id is not null")
    classes = settle(
        real.groupBy("digest").agg(F.min("doc_id").alias("node"), F.min("bands").alias("bands")), "classes"
    )
    bands = settle(classes.groupBy("node").agg(F.flatten(F.collect_set("bands")).alias("bands")), "bands")
    texts = table.join(bands.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    repeated = real.groupBy("doc_id").agg(F.count_distinct("digest").alias("n")).where("n > 1").select("doc_id")
    tied = real.join(repeated, "doc_id", "left_semi").join(classes, "digest").select(
        F.col("doc_id").alias("a"), F.col("node").alias("b")
    )
    tied = settle(tied.where("a <> b").distinct(), "tied")
    comps = links(bands, texts, words, percent)
    if not tied.isEmpty():
        comps = components(comps.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(tied), "final")
    placed = classes.select("digest", "node").join(comps, "node", "left")
    placed = placed.select("digest", F.coalesce("root", "node").alias("root"))
    out = rows.select("doc_id", "n_shingles", "digest").join(placed, "digest", "left")
    root = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", root.alias("component_id"), root.eqNullSafe(F.col("doc_id")).alias("kept")
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """``docs`` with one document of each group and one row of each document; columns and rows are unchanged."""
    groups = settle(near_duplicates(docs, id_col, text_col, words, percent), "groups")
    gone = groups.where("not kept").select("doc_id").distinct()
    again = groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    name = F.col(f"`{id_col}`").cast("long")
    keyed = lambda ids: F.col("doc_id__") == name
    ids = gone.unionAll(again).distinct().select(F.col("doc_id").alias("doc_id__"))
    single = docs.join(ids, keyed(ids), "left_anti")
    again = again.join(gone, "doc_id", "left_anti").select(F.col("doc_id").alias("doc_id__"))
    if again.isEmpty():
        return single
    rest = docs.join(again, keyed(again), "left_semi")
    one = rest.groupBy(name.alias("doc_id__")).agg(F.min(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("r"))
    return single.unionAll(one.select(*(F.col("r").getField(c).alias(c) for c in docs.columns)))
