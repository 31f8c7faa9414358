"""Byte-level BPE encoding and decoding.

A pre-token is a run of bytes. A segment tree over its byte positions holds, for every live position, the rank of the
pair that starts there; the root is the leftmost pair of least rank. A merge joins two neighbours and updates three
leaves, so a pre-token of n bytes takes O(n log n) whatever its length. Pre-tokens repeat, so each Python worker keeps
the ids of those it met lately.

Encoding and decoding are Arrow batch functions (:func:`encode_batches`, :func:`decode_batches`); :func:`encode` and
:func:`decode` run them over a DataFrame, and a caller may chain them in one pass without moving the ids twice.

Nulls are encoded as the empty text (no ids); empty texts give no ids; repeated rows are encoded each by itself; an
empty table gives an empty table; columns of the input other than the text pass through untouched, and an output
column that exists already is refused.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import MEMORIES, require

_NO_PAIR = 1 << 62
#: Children of a node of the segment tree: wide, since a minimum over a short slice is cheap.
FAN = 32
#: Pre-tokens that a worker remembers, in two generations.
_REMEMBER = 250_000


def load_ranks(path: str) -> dict[bytes, int]:
    """``base64 rank`` lines of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: a known piece is one id; else the pair of least rank, leftmost first, is merged on."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    get = ranks.get
    # A leaf holds rank * n + position, so that the least value is the leftmost pair of least rank. Above the leaves,
    # each node holds the least value of its FAN children; the last level has one node's children at most.
    leaves = [_NO_PAIR if (rank := get(piece[i : i + 2])) is None else rank * n + i for i in range(n - 1)]
    leaves.append(_NO_PAIR)
    levels = [leaves]
    while len(levels[-1]) > FAN:
        below = levels[-1]
        levels.append([min(below[i : i + FAN]) for i in range(0, len(below), FAN)])
    top, deep = levels[-1], len(levels) > 1
    after = list(range(1, n + 1))  # where the token that starts here ends, which is where the next one starts
    before = list(range(-1, n))

    def lift(at: int) -> None:
        for k in range(1, len(levels)):
            own = at // FAN
            least = min(levels[k - 1][own * FAN : own * FAN + FAN])
            if levels[k][own] == least:
                return
            levels[k][own] = least
            at = own

    while (best := min(top)) < _NO_PAIR:
        left = best % n
        right = after[left]
        end = after[right]
        after[left] = end
        before[end] = left
        rank = get(piece[left : after[end]]) if end < n else None
        leaves[left] = _NO_PAIR if rank is None else rank * n + left
        leaves[right] = _NO_PAIR
        prior = before[left]
        if prior >= 0:
            rank = get(piece[prior:end])
            leaves[prior] = _NO_PAIR if rank is None else rank * n + prior
        if deep:
            lift(left)
            lift(right)
            if prior >= 0:
                lift(prior)
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : after[at]]])
        at = after[at]
    return ids


class _Memory(dict):
    """Pre-token -> its ids, packed, in two generations: what the older one holds is moved up when it is met again."""

    def __init__(self, ranks: dict[bytes, int], size: int = _REMEMBER):
        super().__init__()
        self.ranks, self.size, self.old = ranks, size, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = array("i", merge(piece.encode("utf-8", "surrogatepass"), self.ranks)).tobytes()
        if len(piece) <= 64:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Encodes texts: the pattern's matches, each by :func:`merge`."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.memory, self.pattern = _Memory(ranks), regex.compile(pattern)
        self.vocabulary = {i: b for b, i in ranks.items()}

    def encode(self, text: str | None) -> np.ndarray:
        """Ids as int32."""
        return np.frombuffer(b"".join(map(self.memory.__getitem__, self.pattern.findall(text))) if text else b"", dtype=np.int32)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


_ENCODERS: dict[tuple[str, str], Encoder] = {}
MEMORIES.append(_ENCODERS)


def encoder(ranks_path: str, pattern: str) -> Encoder:
    """The worker's encoder for a rank file; the file is part of an installed package on every machine."""
    key = (ranks_path, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(load_ranks(ranks_path), pattern)
    return _ENCODERS[key]


def id_lists(column: pa.ListArray) -> Iterator[list[int]]:
    """The lists of a column of ids, nulls as empty lists, without an object per id."""
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    filled = column.is_valid().to_pylist()
    for k in range(len(column)):
        yield flat[offsets[k] : offsets[k + 1]].tolist() if filled[k] else []


def encode_batches(ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Replaces the text column of Arrow batches by a column of ids, a slice of rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                k = batch.schema.get_field_index(text_col)
                own = [enc.encode(t) for t in batch.column(k).to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(own)))
                names = [n for n in batch.schema.names if n != text_col]
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [ids], [*names, ids_col])

    return run


def decode_batches(ranks_path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the bytes that the ids stand for; null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        for batch in batches:
            out = pa.array((enc.decode(ids) for ids in id_lists(batch.column(batch.schema.get_field_index(ids_col)))), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, bytes_col])

    return run


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the text column replaced by ``ids`` array<int>."""
    require(df, text_col)
    kept = [f for f in df.schema.fields if f.name != text_col]
    if ids_col in (f.name for f in kept):
        raise ValueError(f"the table already has a column {ids_col}")
    return df.mapInArrow(encode_batches(ranks_path, pattern, text_col, ids_col), T.StructType([*kept, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes of its ids added."""
    require(df, ids_col)
    if bytes_col in df.columns:
        raise ValueError(f"the table already has a column {bytes_col}")
    return df.mapInArrow(decode_batches(ranks_path, pattern, ids_col, bytes_col), T.StructType([*df.schema.fields, T.StructField(bytes_col, T.BinaryType())]))
