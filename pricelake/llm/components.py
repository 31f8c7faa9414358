"""Connected components of a distributed edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Graphs of at most so many edges are one task's work; larger ones, and what is left of them, go by rounds.
SMALL_EDGES = 200_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the least node reachable.

    Each round every node hooks to its least smaller neighbour, chains are halved by joining the pointers with
    themselves until none is left, and edges are contracted, until what is left is a small graph. Rounds and halvings grow
    with the logarithm of the longest chain; nothing is collected."""
    current = materialise(_oriented(edges), "cc-edges")
    result = None
    while True:
        edges_left = current.count()
        if edges_left <= SMALL_EDGES:
            rest = materialise(current.coalesce(1).mapInArrow(_union_find, "node long, root long"), "cc-rest")
            if result is None:
                return rest
            last = rest.select(F.col("node").alias("root"), F.col("root").alias("__last"))
            return materialise(result.join(last, "root", "left").select("node", F.coalesce("__last", "root").alias("root")), "cc-roots")
        pointers = materialise(current.groupBy("a").agg(F.min("b").alias("p")), "cc-hooks")
        while True:
            far = pointers.select(F.col("a").alias("p"), F.col("p").alias("__far"))
            jumped = materialise(pointers.join(far, "p", "left").select("a", F.coalesce("__far", "p").alias("p"), F.col("__far").isNotNull().alias("__moved")), "cc-jumps")
            pointers = jumped.select("a", "p")
            if jumped.where("__moved").isEmpty():
                break
        if result is None:
            ends = current.select(F.col("b").alias("node")).distinct().join(pointers.select(F.col("a").alias("node")), "node", "left_anti")
            result = pointers.select(F.col("a").alias("node"), F.col("p").alias("root")).unionByName(ends.select("node", F.col("node").alias("root")))
        else:
            result = result.join(pointers.select(F.col("a").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        result = materialise(result, "cc-roots")
        to = pointers.select(F.col("a").alias("__x"), F.col("p").alias("__p"))
        moved = current.join(to, current["a"] == F.col("__x"), "left").select(F.coalesce("__p", "a").alias("a"), "b")
        moved = moved.join(to, moved["b"] == F.col("__x"), "left").select("a", F.coalesce("__p", "b").alias("b"))
        current = materialise(_oriented(moved), "cc-edges")


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
