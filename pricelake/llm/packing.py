"""Best-fit packing of token sequences.

Best-fit decreasing looks at items from the longest to the shortest and puts each into the open bin with the least room
that still takes it. Items of one length are interchangeable, and so are bins with the same room; so the search runs on
classes: a segment tree over the room values 0..capacity counts the open bins of each, and the tightest room that takes
an item is found in O(log capacity). The outcome is that of the item-by-item algorithm, but its cost depends on the
number of lengths, not of documents, and what reaches the driver is a histogram of at most ``capacity`` rows.

Documents find their place by their rank among those of the same length. The ranks come from two levels (offsets of
hash groups, then positions inside a group), so a length that a third of all documents share is never sorted in one task.

Null texts count as empty ones (one end id); empty tables give an empty result; repeated rows are packed each by itself;
other input columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MEMORIES, materialise, require, trim

#: Words that a worker remembers, in two generations.
_REMEMBER, _REMEMBER_RUNS = 500_000, 300_000
#: Documents of one length are ranked in so many groups at first; groups are by a hash of the row.
_RANK_GROUPS = 64


class OpenBins:
    """A segment tree over room values: counts of open bins, and the least room >= x that has any."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.tree = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        at = room + self.leaves
        while at:
            self.tree[at] += n
            at >>= 1

    def tightest(self, least: int) -> int | None:
        """The least room >= ``least`` with an open bin."""
        at = least + self.leaves
        if self.tree[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over classes. ``histogram``: items of each length 1..capacity.

    Rows (length, rank_from, rank_to, first_bin, at, per_bin): items ``rank_from <= rank < rank_to`` of that length go
    to bins ``first_bin + (rank - rank_from) // per_bin``, at offset ``at + (rank - rank_from) % per_bin * length``.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    bins: dict[int, list[tuple[int, int]]] = {}  # room -> runs of bin numbers
    open_bins, used = OpenBins(capacity), 0

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            bins.setdefault(room, []).append((first, n))
            open_bins.add(room, n)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = open_bins.tightest(length)
            if room is None:
                first, n, room = used, -(-left // (capacity // length)), capacity
                used += n
            else:
                first, n = bins[room].pop()
                open_bins.add(room, -n)
            per_bin = room // length
            full, rest = divmod(min(left, n * per_bin), per_bin)
            items = full * per_bin + rest
            rows.append((length, rank, rank + items, first, capacity - room, per_bin))
            leave(room - per_bin * length, first, full)
            if rest:
                leave(room - rest * length, first + full, 1)
            leave(room, first + full + bool(rest), n - full - bool(rest))
            rank, left = rank + items, left - items
    return rows


#: A word that is one run of Latin letters, then marks: two pre-tokens at most, which the model encodes by themselves.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")


class _Words(dict):
    """Word -> its ids, packed little-endian, in two generations."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.old, self.runs = Tokenizer.from_file(path), {}, {}
        self.model = self.tokenizer.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # How the byte-level step writes each character of a plain word.
        self.written = {ord(c): level.pre_tokenize_str(c)[0][0] for c in map(chr, (*range(33, 127), *range(0xC0, 0x100)))}
        self.specials = any(t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not t.content.startswith("<|"))

    def run(self, text: str) -> bytes:
        """Ids of one pre-token."""
        ids = self.runs.get(text)
        if ids is None:
            found = [t.id for t in self.model.tokenize(text.translate(self.written))]
            ids = struct.pack(f"<{len(found)}I", *found)
            if len(self.runs) >= _REMEMBER_RUNS:
                self.runs.clear()
            self.runs[text] = ids
        return ids

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            text = word.decode()
            plain = _PLAIN.fullmatch(text) if len(text) <= 100 and "<|" not in text and not self.specials else None
            if plain:
                letters, marks = plain.groups()
                ids = (self.run(letters.lower()) if letters else b"") + (self.run(marks) if marks else b"")
            else:
                found = self.tokenizer.encode(text, add_special_tokens=False).ids
                ids = struct.pack(f"<{len(found)}I", *found)
        if len(word) <= 64:
            if len(self) >= _REMEMBER:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


_WORDS: dict[str, _Words] = {}
MEMORIES.append(_WORDS)

PIECES = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()))])


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """One row per piece of every document: its place in the document, its length and the crc32 of its ids, and with
    ``with_ids`` the ids themselves. Tokens never span ASCII white space in a pre-split tokenizer, so words are encoded
    once and looked up after."""
    require(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _WORDS:
            _WORDS[tokenizer_path] = _Words(tokenizer_path)
        words = _WORDS[tokenizer_path]
        end = struct.pack("<I", end_id)
        size = 4 * capacity
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                texts = [t.split() if t else [] for t in batch.column(1).cast(pa.binary()).to_pylist()]  # at ASCII white space only
                out: list[list] = [[] for _ in range(5 + with_ids)]
                for doc_id, parts in zip(batch.column(0).to_pylist(), texts, strict=True):
                    ids = b"".join(map(words.__getitem__, parts)) + end
                    for piece, start in enumerate(range(0, len(ids), size)):
                        own = ids[start : start + size]
                        row = [doc_id, piece, start // 4, len(own) // 4, zlib.crc32(own)]
                        if with_ids:
                            row.append(memoryview(own).cast("I").tolist())
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], [*PIECES.names, *["ids"] * with_ids])
        trim()

    schema = T.StructType([*PIECES.fields, *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def ranked(pieces: DataFrame, by: str = "length") -> DataFrame:
    """``pieces`` with ``__rank``, gapless from 0 among the rows of one value of ``by``."""
    grouped = pieces.withColumn("__group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(_RANK_GROUPS)).cast("int"))
    offsets = (
        grouped.groupBy(by, "__group")
        .agg(F.count("*").alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(by).orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select(by, "__group", "__before")
    )
    inside = F.row_number().over(Window.partitionBy(by, "__group").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return grouped.withColumn("__inside", inside).join(offsets, [by, "__group"]).withColumn("__rank", F.col("__before") + F.col("__inside")).drop("__group", "__inside", "__before")


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with ``doc_id, piece, length, ids_crc32`` (and any others).

    Full pieces fill a sequence alone. The histogram and the plan have at most a few rows per length."""
    pieces = materialise(pieces, "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 1 <= n <= capacity for n in histogram):
        raise ValueError("a piece is empty or longer than the capacity")
    steps = pieces.sparkSession.createDataFrame(plan(histogram, capacity), "length long, rank_from long, rank_to long, first_bin long, at long, per_bin long")
    nth = F.col("__rank") - F.col("rank_from")
    return (
        ranked(pieces)
        .join(F.broadcast(steps), "length")
        .where((F.col("__rank") >= F.col("rank_from")) & (F.col("__rank") < F.col("rank_to")))
        .withColumn("sequence_id", F.col("first_bin") + F.floor(nth / F.col("per_bin")).cast("long"))
        .withColumn("offset", F.col("at") + nth % F.col("per_bin") * F.col("length"))
        .select(*pieces.columns, "sequence_id", "offset")
    )
