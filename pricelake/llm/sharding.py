"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Every shard owns many points (virtual nodes) of a ring of hash values; a key belongs to the next point clockwise. A
shard takes no more keys than its bound: keys that find it full go on clockwise to the next point of a shard that isn't.
The bounds add up to the number of keys, so shards end within one key of each other (law ``rows``), and a key moves only
if an arc before it changes.

The ring has ``shards * points`` arcs whatever the data. Keys of an arc are ordered by hash; arcs are counted (a
partial aggregate), and only these counts, a table of fixed size, are walked clockwise to find which stretch of which
arc goes to which shard. Places inside an arc come from two levels (offsets of sub-arcs, then positions inside one), so
no task sorts more than a sub-arc. The key is a hash of doc_id and of the text, so a doc_id that many rows share (or
that is null) still spreads.

Null texts have no bytes (size 1, crc32 0); null ids are placed by their text; equal rows take neighbouring slots in any
order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, require

#: The ring's positions: 0 .. 2**52 - 1, exact in every number type.
RING = 1 << 52
#: Arcs are counted and ranked in so many parts.
SUB_ARCS = 16


def ring_position(*columns: Column) -> Column:
    """A position from the first 13 hexadecimal digits of an md5, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *columns).cast("binary")), 1, 13), 16, 10).cast("long")


def ring_points(spark: SparkSession, shards: int, points: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, clockwise."""
    nodes = spark.range(shards).withColumnRenamed("id", "shard").withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    placed = nodes.select(ring_position(F.lit("node"), F.col("shard").cast("string"), F.col("point").cast("string")).alias("position"), "shard")
    return sorted((r["position"], r["shard"]) for r in placed.collect())


def walk(counts: list[int], owners: list[int], bounds: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Deals the arcs' keys out. ``counts``: keys of each arc; ``owners``: the shard at each arc's end; ``bounds``: what
    each shard takes. Rows (arc, rank_from, rank_to, shard, first_slot).

    Every key first goes to its own arc's owner; what a full shard turns away walks on from there, arc after arc, until
    a shard has room. Earlier ranks of an arc are taken first."""
    room, taken = list(bounds), [0] * len(bounds)
    rows: list[tuple[int, int, int, int, int]] = []

    def give(arc: int, rank: int, n: int, shard: int) -> int:
        got = min(n, room[shard])
        if got:
            rows.append((arc, rank, rank + got, shard, taken[shard]))
            room[shard] -= got
            taken[shard] += got
        return got

    turned_away = []
    for arc, n in enumerate(counts):
        got = give(arc, 0, n, owners[arc])
        if got < n:
            turned_away.append((arc, got, n - got))
    for arc, rank, n in turned_away:
        at = arc
        while n:
            at = (at + 1) % len(owners)
            got = give(arc, rank, n, owners[at])
            rank, n = rank + got, n - got
    return rows


def shard(docs: DataFrame, shards: int = 16, points: int = 128) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is ``rows``)."""
    require(docs, "doc_id", "text")
    spark = docs.sparkSession
    ring = ring_points(spark, shards, points)
    positions, owners = [p for p, _ in ring], [s for _, s in ring]
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("__at", ring_position(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text_crc32").cast("string"), F.col("size").cast("string")))
    # The next point clockwise: how many points lie before the position, by bisection of a constant array.
    arc = F.expr(_bisect("__at", len(positions)))
    ends = F.array(*[F.lit(p) for p in positions])
    placed = (
        keyed.withColumn("__ends", ends)
        .withColumn("__arc", arc % len(positions))
        .drop("__ends")
        .withColumn("__sub", F.pmod(F.xxhash64("__at"), F.lit(SUB_ARCS)).cast("int"))
    )
    placed = materialise(placed, "ring-keys")
    counted = placed.groupBy("__arc", "__sub").agg(F.count("*").alias("__n"))
    counted = materialise(counted, "ring-counts")  # at most shards * points * SUB_ARCS rows
    counts = [0] * len(owners)
    for r in counted.groupBy("__arc").agg(F.sum("__n").alias("n")).collect():
        counts[r["__arc"]] = r["n"]
    share, more = divmod(sum(counts), shards)
    steps = walk(counts, owners, [share + (s < more) for s in range(shards)])
    stretches = spark.createDataFrame(steps, "__arc long, rank_from long, rank_to long, shard int, first_slot long")
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__arc").orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counted.select("__arc", "__sub", before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__arc", "__sub").orderBy("__at", "doc_id", "text_crc32", "size")) - 1
    return (
        placed.withColumn("__inside", inside)
        .join(F.broadcast(offsets), ["__arc", "__sub"])
        .withColumn("__rank", F.col("__before") + F.col("__inside"))
        .join(F.broadcast(stretches), "__arc")
        .where((F.col("__rank") >= F.col("rank_from")) & (F.col("__rank") < F.col("rank_to")))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            "shard",
            (F.col("first_slot") + F.col("__rank") - F.col("rank_from")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def _bisect(position: str, n: int) -> str:
    """SQL for the number of elements of ``__ends`` (ascending) below ``position``: a bisection over bits."""
    steps, bit = [], 1
    while bit <= n:
        steps.append(bit)
        bit *= 2
    steps.reverse()
    return f"aggregate(array({', '.join(map(str, steps))}), 0, (lo, bit) -> if(lo + bit <= {n} and __ends[lo + bit - 1] < {position}, lo + bit, lo))"
