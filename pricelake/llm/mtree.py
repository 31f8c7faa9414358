"""Exact top-k search by inner product in M-trees.

Vectors are dealt out to trees of bounded size. A tree's nodes are pages; each has a routing vector, a covering radius
and, for every entry, the distance to the routing vector (the parent distance). For a query q and an entry p below a
node with routing vector o, the inner product <q, p> is at most <q, o> + |q| * d(p, o), and below the whole node at most
<q, o> + |q| * radius: so a page is skipped, and an entry is never multiplied out, when the stored distances show that it
can't reach the k-th best. Search is best-first by these bounds.

Queries are grouped in blocks of bounded size. A query first searches one tree, its home; the k-th best it finds there
bounds the search in all others, each of which returns at most k rows that are no worse. Blocks meet trees by an
equi-join on the tree's number: a stated query set against all rows, in blocks.

What is skipped depends on the data: clusters that are narrow beside the distance of the k-th best are; of directions
without structure in many dimensions hardly any page is, as all balls reach over all others.

Vectors that are null or hold null or non-finite components take no part; shorter vectors count as padded by zeros; ties
go to the smaller vec_id; rows with the query's own vec_id are never its candidates; repeated rows are candidates each by itself, and an id that
repeats is asked once, with its least vector; null ids take no part; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, require

PAGE, FAN = 256, 16
#: Vectors of a tree, and queries of a block.
TREE_VECTORS, BLOCK_QUERIES = 8192, 512
#: Products are exact in doubles while they stay below this.
_EXACT = float(1 << 52)


class Node:
    __slots__ = ("children", "distances", "first", "last", "product_bound", "radius", "route")

    def __init__(self, route: np.ndarray, radius: float, distances: np.ndarray, children: list | None, first: int, last: int):
        self.route, self.radius, self.distances, self.children, self.first, self.last = route, radius, distances, children, first, last


class MTree:
    """Bulk-loaded: entries of a page lie next to each other in ``vectors``."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        #: Entries multiplied out by :meth:`top` so far.
        self.computed = 0
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order].astype(float)
        place: list[np.ndarray] = []
        self.root = self._load(np.arange(len(ids)), place, 0)[0]
        at = np.concatenate(place) if place else np.empty(0, dtype=np.int64)
        self.ids, self.vectors = self.ids[at], self.vectors[at]
        self.whole = vectors[order][at] if np.abs(vectors).max(initial=0) > 0 and float(np.abs(vectors).max()) ** 2 * max(1, vectors.shape[1]) >= _EXACT else None

    def _load(self, rows: np.ndarray, place: list[np.ndarray], first: int) -> tuple[Node, int]:
        own = self.vectors[rows]
        route = own.mean(axis=0) if len(rows) else np.zeros(self.vectors.shape[1])
        away = np.linalg.norm(own - route, axis=1)
        if len(rows) <= PAGE:
            order = np.argsort(away, kind="stable")
            place.append(rows[order])
            return Node(route, float(away.max(initial=0.0)), away[order], None, first, first + len(rows)), first + len(rows)
        k = min(FAN, -(-len(rows) // PAGE))
        seeds = own[np.linspace(0, len(rows) - 1, k).astype(int)]
        nearest = np.argmin((seeds * seeds).sum(axis=1) - 2 * own @ seeds.T, axis=1)
        groups = [g for g in (np.flatnonzero(nearest == j) for j in range(k)) if len(g)]
        if len(groups) == 1:  # vectors that can't be told apart
            groups = np.array_split(np.arange(len(rows)), k)
        children = []
        for g in groups:
            child, first = self._load(rows[g], place, first)
            children.append(child)
        distances = np.array([np.linalg.norm(c.route - route) for c in children])
        return Node(route, float(away.max()), distances, children, children[0].first, first), first

    def top(self, query: np.ndarray, own_id: int, k: int, floor: tuple[float, int] | None = None) -> list[tuple[int, int]]:
        """The best k as (score, id), best first; only those no worse than ``floor`` (score, id) where it is given."""
        q = query.astype(float)
        length = float(np.sqrt(q @ q)) * (1 + 1e-12) + 1e-9
        best: list[tuple[int, int]] = []  # a heap of (score, -id)
        bar = -np.inf if floor is None else float(floor[0])
        heap: list[tuple[float, int, float, Node]] = []
        product = float(q @ self.root.route)
        heapq.heappush(heap, (-(product + length * self.root.radius), 0, product, self.root))
        serial = 0
        while heap:
            bound, _, product, node = heapq.heappop(heap)
            slack = 1e-6 * (1 + abs(bound))
            if -bound + slack < bar:
                break
            reach = product + length * node.distances  # of each entry, without a product
            if node.children is not None:
                for child, near in zip(node.children, reach.tolist(), strict=True):
                    if near + length * child.radius + slack < bar:
                        continue
                    inner = float(q @ child.route)
                    upper = inner + length * child.radius
                    if upper + slack >= bar:
                        serial += 1
                        heapq.heappush(heap, (-upper, serial, inner, child))
                continue
            rows = np.arange(node.first + int(np.searchsorted(reach, bar - slack)), node.last)  # distances ascend, so bounds do
            if not len(rows):
                continue
            self.computed += len(rows)
            scores = self.whole[rows] @ query if self.whole is not None else np.rint(self.vectors[rows] @ q).astype(np.int64)
            ids = self.ids[rows]
            good = (scores >= bar) & (ids != own_id)
            if not good.any():
                continue
            for score, i in zip(scores[good].tolist(), ids[good].tolist(), strict=True):
                if floor is not None and (score, -i) < (floor[0], -floor[1]):
                    continue
                if len(best) < k:
                    heapq.heappush(best, (score, -i))
                elif (score, -i) > best[0]:
                    heapq.heapreplace(best, (score, -i))
            if len(best) == k:
                bar = max(bar, float(best[0][0]))
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def _matrix(values: list[bytes], width: int | None = None) -> np.ndarray:
    rows = [np.frombuffer(v, dtype=np.int64) for v in values]
    width = max([width or 0, *map(len, rows)])
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def quantised(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """(vec_id, packed): components floor(scale * x) as int64, of the vectors that take part."""
    require(vectors, "vec_id", "embedding")
    broken = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    valid = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~broken).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array(v, dtype=np.int64).tobytes() for v in batch.column(1).to_pylist()], pa.binary())], ["vec_id", "packed"])

    return valid.mapInArrow(run, "vec_id long, packed binary")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0) -> DataFrame:
    """For each query its best k: query_id, rank, vec_id, score. ``is_query`` is a condition on ``vec_id``."""
    points = materialise(quantised(vectors, scale), "vectors")
    queries = points.where(is_query).groupBy("vec_id").agg(F.min("packed").alias("packed"))
    trees, blocks = max(1, -(-points.count() // TREE_VECTORS)), max(1, -(-queries.count() // BLOCK_QUERIES))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"tree": pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([np.array(table.column("vec_id").to_pylist(), dtype=np.int64).tobytes()], pa.binary()), "vectors": pa.array([table.column("packed").to_pylist()], pa.list_(pa.binary()))})

    number = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n))
    pages = materialise(points.withColumn("tree", number(trees, 1)).groupBy("tree").applyInArrow(pack, "tree long, ids binary, vectors array<binary>"), "trees")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, MTree | None] = (None, None)
        for whole in batches:
            for at in range(whole.num_rows):
                row = whole.slice(at, 1).to_pylist()[0]
                if held[0] != row["tree"]:
                    held = (row["tree"], MTree(np.frombuffer(row["ids"], dtype=np.int64), _matrix(row["vectors"])))
                tree = held[1]
                found = []
                for q in row["queries"]:
                    query = np.frombuffer(q["packed"], dtype=np.int64)
                    width = tree.vectors.shape[1]
                    query = np.pad(query, (0, max(0, width - len(query))))[:width]
                    floor = None if q["bar"] is None else (q["bar"], q["bar_id"])
                    found += [(q["vec_id"], i, s) for s, i in tree.top(query, q["vec_id"], k, floor)]
                yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.int64()) for j in range(3)], ["query_id", "vec_id", "score"])

    def against(asked: DataFrame) -> DataFrame:
        """``asked``: (tree, block, vec_id, packed, bar, bar_id)."""
        grouped = asked.groupBy("tree", "block").agg(F.collect_list(F.struct("vec_id", "packed", "bar", "bar_id")).alias("queries"))
        return grouped.join(pages, "tree").select("tree", "ids", "vectors", "queries").mapInArrow(search, "query_id long, vec_id long, score long")

    first_k = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(first_k)).where(F.col("rank") <= k)
    blocked = queries.withColumn("home", number(trees, 1)).withColumn("block", number(blocks, 2))
    no_bar = [F.lit(None).cast("long").alias("bar"), F.lit(None).cast("long").alias("bar_id")]
    at_home = materialise(ranked(against(blocked.select(F.col("home").alias("tree"), "block", "vec_id", "packed", *no_bar))), "at-home")
    bars = at_home.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bar"), F.col("vec_id").alias("bar_id"))
    others = blocked.join(bars, "vec_id", "left").withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)).cast("array<bigint>"))).where("tree <> home")
    away = against(others.select("tree", "block", "vec_id", "packed", "bar", "bar_id"))
    return ranked(at_home.drop("rank").unionByName(away)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
