"""Approximate nearest neighbours by cosine: a hierarchical navigable small-world graph per shard.

Distinct vectors are indexed once, each with the ``k + 1`` smallest ids that hold it (all that ties can ever ask for), so
a group of copies of any size is one node.  Distinct vectors are dealt to shards of about ``SHARD`` by a hash; every shard
holds its unit vectors and, per level, one flat array of neighbour positions.  Queries travel in blocks of
``QUERY_BLOCK`` to every shard; each shard answers with its nearest nodes, exact double-precision cosines on the
original vectors are taken there, and the shard results are merged per query by a top-k aggregate with ties to the
smaller id.

Defined results: null and zero vectors and those that hold null or non-finite components, or a null id, take no part,
neither as query nor as candidate.  Vectors of another length than the most common one are compared with their own
length only (each length has its own shards).  Rows that repeat an id are all candidates; a query never returns its own
id, and an id is returned once.  Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohorta.llm.common import column, map_batches
from kohorta.session import settle

LINKS = 16  # neighbours kept per node above level 0; twice as many on level 0
BUILD = 80  # candidates looked at when a node is linked
SEARCH = 160  # candidates looked at when a query is answered
SHARD = 8192
QUERY_BLOCK = 256


class Graph:
    """One shard's graph over unit vectors: ``levels[l]`` is a flat (nodes, links) array of positions, -1 for none."""

    def __init__(self, unit: np.ndarray, levels: list[np.ndarray] | None = None, entry: int = 0) -> None:
        self.unit, self.entry = unit, entry
        self.levels = levels if levels is not None else []
        self.visited = np.zeros(len(unit), np.int64)
        self.stamp = 0

    def search(self, q: np.ndarray, starts: list[int], level: int, width: int) -> list[tuple[float, int]]:
        """Up to ``width`` near nodes of a level as (similarity, node), nearest first."""
        self.stamp += 1
        links, unit, visited, stamp = self.levels[level], self.unit, self.visited, self.stamp
        visited[starts] = stamp
        near = [(float(unit[s] @ q), s) for s in starts]
        best = near[:]
        heapq.heapify(best)
        ahead = [(-s, n) for s, n in near]
        heapq.heapify(ahead)
        while ahead:
            far, node = heapq.heappop(ahead)
            if len(best) >= width and -far < best[0][0]:
                break
            row = links[node]
            row = row[row >= 0]
            row = row[visited[row] != stamp]
            if not len(row):
                continue
            visited[row] = stamp
            for s, n in zip((unit[row] @ q).tolist(), row.tolist(), strict=True):
                if len(best) < width:
                    heapq.heappush(best, (s, n))
                    heapq.heappush(ahead, (-s, n))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, n))
                    heapq.heappush(ahead, (-s, n))
        return sorted(best, reverse=True)

    def _choose(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours that are nearer to the node than to one another; filled up with the nearest others."""
        nodes = np.array([n for _, n in found])
        if len(nodes) <= most:
            return nodes.tolist()
        between = self.unit[nodes] @ self.unit[nodes].T
        kept: list[int] = []
        rest: list[int] = []
        for k, (s, _) in enumerate(found):
            if len(kept) == most:
                break
            (rest if kept and between[k, kept].max() > s else kept).append(k)
        return nodes[(kept + rest)[:most]].tolist()

    def build(self, seed: int = 5) -> Graph:
        """Insert all nodes one by one."""
        n = len(self.unit)
        height = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int), 12)
        top = -1
        for node in range(n):
            q, own = self.unit[node], int(height[node])
            while len(self.levels) <= own:
                self.levels.append(np.full((n, LINKS * (1 if self.levels else 2)), -1, np.int32))
            if top < 0:
                self.entry, top = node, own
                continue
            starts = [self.entry]
            for level in range(top, -1, -1):
                found = self.search(q, starts, level, BUILD if level <= own else 1)
                starts = [m for _, m in found]
                if level <= own:
                    self._link(node, found, level)
            if own > top:
                self.entry, top = node, own
        return self

    def _link(self, node: int, found: list[tuple[float, int]], level: int) -> None:
        links = self.levels[level]
        most = links.shape[1]
        chosen = self._choose(found, LINKS)
        links[node, : len(chosen)] = chosen
        for other in chosen:
            row = links[other]
            free = np.flatnonzero(row < 0)
            if len(free):
                row[free[0]] = node
                continue
            all_ = np.append(row, node)
            s = self.unit[all_] @ self.unit[other]
            order = np.argsort(-s, kind="stable")
            kept = self._choose([(float(s[k]), int(all_[k])) for k in order], most)
            row[:] = -1
            row[: len(kept)] = kept

    def nearest(self, q: np.ndarray, width: int) -> list[int]:
        starts = [self.entry]
        for level in range(len(self.levels) - 1, 0, -1):
            starts = [n for _, n in self.search(q, starts, level, 1)]
        return [n for _, n in self.search(q, starts, 0, width)]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vector (doubles) of the rows that take part."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("vector"), fine.alias("f"), some.alias("s"))
    return rows.where("vec_id is not null and f and s").select("vec_id", "vector")


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """key, vector (bytes), ids (the ``keep`` smallest distinct ids) of every distinct vector.

    Each task keeps the smallest ids per vector before the shuffle, so copies cost a bounded number of rows per task.
    """

    def lessen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[bytes, list[int]] = {}
            for i, v in zip(column(batch, "vec_id"), column(batch, "vector"), strict=True):
                held.setdefault((np.array(v, "<f8") + 0.0).tobytes(), []).append(i)
            yield pa.RecordBatch.from_pydict(
                {"vector": list(held), "ids": [sorted(set(i))[:keep] for i in held.values()]},
                schema=pa.schema([("vector", pa.binary()), ("ids", pa.list_(pa.int64()))]),
            )

    few = rows.mapInArrow(lessen, "vector binary, ids array<long>")
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
    return few.groupBy("vector").agg(least.alias("ids")).select(F.xxhash64("vector").alias("key"), "vector", "ids")


def build_shards(nodes: DataFrame, shards: int) -> DataFrame:
    """shard, vectors, ids, entry, levels: one row per shard with its flat arrays."""

    def run(group: pa.Table) -> pa.Table:
        order = sorted(zip(group["key"].to_pylist(), group["vector"].to_pylist(), group["ids"].to_pylist(), strict=True))
        vectors = np.array([np.frombuffer(v, "<f8") for _, v, _ in order])
        scale = np.abs(vectors).max(axis=1, keepdims=True)
        unit = vectors / scale
        unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
        graph = Graph(unit).build()
        return pa.Table.from_pydict(
            {
                "shard": [group["shard"][0].as_py()],
                "size": [vectors.shape[1]],
                "vectors": [vectors.tobytes()],
                "ids": [[i for _, _, i in order]],
                "entry": [graph.entry],
                "levels": [[x.tobytes() for x in graph.levels]],
            },
            schema=pa.schema(
                [
                    ("shard", pa.string()), ("size", pa.int32()), ("vectors", pa.binary()),
                    ("ids", pa.list_(pa.list_(pa.int64()))), ("entry", pa.int32()), ("levels", pa.list_(pa.binary())),
                ]
            ),
        )

    size = (F.length("vector") / 8).cast("int")
    dealt = nodes.withColumn(
        "shard", F.concat_ws("/", size.cast("string"), F.pmod(F.xxhash64("key"), F.lit(shards)).cast("string"))
    )
    return dealt.groupBy("shard").applyInArrow(
        run, "shard string, size int, vectors binary, ids array<array<long>>, entry int, levels array<binary>"
    )


def search_shards(index: DataFrame, queries: DataFrame, k: int, width: int = SEARCH) -> DataFrame:
    """query_id, vec_id, score: the nearest ``k`` ids of every shard (a few more where ties are cut)."""
    per = QUERY_BLOCK
    blocks = queries.withColumn("size", F.size("vector"))
    count = blocks.count()
    number = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-count // per)))).alias("block")
    blocks = blocks.groupBy("size", number).agg(F.collect_list(F.struct("vec_id", "vector")).alias("queries"))
    places = index.select("shard", "size").distinct()
    sent = blocks.join(places, "size").select("shard", "queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, graph, vectors, norms, ids = None, None, None, None, None
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(c)[r] for c, n in enumerate(batch.schema.names)}
                shard = row["shard"].as_py()
                if shard != held:
                    held = shard
                    vectors = np.frombuffer(row["vectors"].as_py(), "<f8").reshape(-1, row["size"].as_py())
                    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
                    norms = np.linalg.norm(vectors, axis=1)
                    levels = [np.frombuffer(x, np.int32).reshape(len(vectors), -1) for x in row["levels"].as_py()]
                    graph = Graph((vectors / norms[:, None]).astype(np.float32), levels, row["entry"].as_py())
                    ids = row["ids"].as_py()
                out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
                for query in row["queries"].as_py():
                    q = np.array(query["vector"])
                    q = q / np.abs(q).max()
                    own = q / np.linalg.norm(q)
                    nodes = np.array(graph.nearest(own.astype(np.float32), max(width, k)))
                    cosines = (vectors[nodes] @ q) / (norms[nodes] * np.linalg.norm(q))
                    taken = 0
                    for j in np.argsort(-cosines, kind="stable").tolist():
                        if taken > k and cosines[j] < last:
                            break
                        last = cosines[j]
                        for i in ids[nodes[j]]:
                            if i != query["vec_id"]:
                                out["query_id"].append(query["vec_id"])
                                out["vec_id"].append(i)
                                out["score"].append(float(last))
                                taken += 1
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    joined = sent.join(index.drop("size").withColumn("size", F.split("shard", "/")[0].cast("int")), "shard")
    joined = joined.select("shard", "size", "vectors", "ids", "entry", "levels", "queries")
    return joined.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard: int = SHARD,
    width: int = SEARCH,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row that ``is_query`` names, against all rows."""
    rows = usable(vectors, id_col, vector_col)
    nodes = settle(distinct_vectors(rows, k + 1), "nodes")
    shards = max(1, -(-nodes.count() // shard))
    index = settle(build_shards(nodes, int(shards)), "graphs")
    queries = settle(usable(vectors.where(is_query), id_col, vector_col).groupBy("vec_id").agg(F.min("vector").alias("vector")), "queries")
    found = search_shards(index, queries, k, width)
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = F.struct((-F.col("score")).alias("o"), F.col("vec_id"), F.col("score"))
    top = once.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("top"))
    return top.select("query_id", F.posexplode("top").alias("r", "t")).select(
        "query_id", (F.col("r") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), F.col("t.score").alias("score")
    )
