"""Repeated passages by sparse suffix arrays.

A suffix of a document's words is retained where the hash of its first ``GRAM`` words is the least in some window of
``min_words`` words (a minimiser). Which positions are retained depends on the words alone, so two copies of a passage
of ``min_words`` words retain a suffix at the same place in it.

First the retained suffixes of all documents are sorted by their first words and neighbours compared: a suffix whose
neighbours all come from its own document is dropped. The others are extended to the left and to the right: every
window of ``min_words`` words whose minimiser the suffix is, is hashed, sorted and compared with its neighbours in turn;
overlapping windows that are found in another document join into one span. The result is exact: a word is in a span if
and only if it lies in a run of ``min_words`` words that another document has too.

Both comparisons are packed exchanges: a batch of documents asks each bucket of the hash range once for what it holds
(so a passage that a third of all documents share is one entry per batch), and gets two bits back for each entry. The
filter between the two passes is a bitmap of fixed size, which only lets more through as it fills.

Null texts and texts with fewer words than ``min_words`` have no spans; rows with the same doc_id are one document, rows
with a null id are told apart by their text; equal rows count once; an empty table gives an empty result; other columns
are ignored by :func:`repeats` and kept by :func:`without_copies`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, materialise, require, trim, trimmed
from .words import WordHashes, gram_hashes, mixed

GRAM = 12
FILTER_BITS = 1 << 24
#: Entries that a batch asks at once.
BATCH_ENTRIES = 60_000
#: Spans are broadcast up to so many documents; beyond, documents are joined by shuffle.
BROADCAST_DOCS = 200_000
_FACTOR = np.uint64(0xD6E8FEB86659FD93)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in pieces, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Windows:
    """Hashes of all windows of ``size`` words, from prefix sums of a polynomial modulo 2^64."""

    def __init__(self, size: int):
        self.size = size
        self.inverse = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
        self._grow(4096)

    def _grow(self, n: int) -> None:
        self.up, self.down = _powers(n, _FACTOR), _powers(n, self.inverse)

    def hashes(self, h: np.ndarray) -> np.ndarray:
        n = len(h)
        if n > len(self.up):
            self._grow(2 * n)
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(h * self.up[:n], dtype=np.uint64)))
        return mixed((sums[self.size :] - sums[: n - self.size + 1]) * self.down[: n - self.size + 1])


def minimisers(grams: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` grams, the position of its least one."""
    out = np.empty(len(grams) - width + 1, dtype=np.int64)
    for at in range(0, len(out), 65_536):
        view = np.lib.stride_tricks.sliding_window_view(grams[at : at + 65_536 + width - 1], width)
        out[at : at + 65_536] = view.argmin(axis=1) + np.arange(at, at + len(view))
    return out


def _bounds(h: np.ndarray, buckets: int) -> np.ndarray:
    bucket = ((h >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
    return np.searchsorted(bucket, np.arange(buckets + 1))


def _entries(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes ascending, least owner, has it several owners?, where each of ``h`` is among them)."""
    order = np.lexsort((owner, h))
    hs, os = h[order], owner[order]
    new = np.concatenate(([True], hs[1:] != hs[:-1])) if len(hs) else np.empty(0, dtype=bool)
    starts = np.flatnonzero(new)
    several = np.maximum.reduceat(os, starts) != os[starts] if len(starts) else np.empty(0, dtype=bool)
    where = np.empty(len(h), dtype=np.int64)
    where[order] = np.cumsum(new) - 1
    return hs[starts], os[starts], several, where


_ASK = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("batch", pa.string()), ("hashes", pa.binary()), ("owners", pa.binary()), ("several", pa.binary()), ("place", pa.binary())])
_ASK_DDL = "kind int, bucket int, batch string, hashes binary, owners binary, several binary, place binary"


def _questions(batch: str, h: np.ndarray, least: np.ndarray, several: np.ndarray, buckets: int) -> Iterator[dict]:
    edges = _bounds(h, buckets)
    for b in range(buckets):
        own = slice(edges[b], edges[b + 1])
        if edges[b] < edges[b + 1]:
            yield {"kind": 1, "bucket": b, "batch": batch, "hashes": h[own].tobytes(), "owners": least[own].tobytes(), "several": np.packbits(several[own]).tobytes()}


def _resolve(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(hashes, repeated?, is the asker's least owner the first of all?) of a bucket's questions, and their lengths."""
    h = np.frombuffer(b"".join(r["hashes"] for r in rows), dtype=np.uint64)
    owner = np.frombuffer(b"".join(r["owners"] for r in rows), dtype=np.int64)
    lengths = [len(r["hashes"]) // 8 for r in rows]
    several = np.concatenate([np.unpackbits(np.frombuffer(r["several"], dtype=np.uint8), count=n) for r, n in zip(rows, lengths, strict=True)])
    order = np.argsort(h, kind="stable")
    hs, os = h[order], owner[order]
    new = np.concatenate(([True], hs[1:] != hs[:-1]))
    starts, run = np.flatnonzero(new), np.cumsum(new) - 1
    first, last = np.minimum.reduceat(os, starts), np.maximum.reduceat(os, starts)
    many = (first != last) | (np.maximum.reduceat(several[order], starts) > 0)
    repeated, leads = np.empty(len(h), dtype=bool), np.empty(len(h), dtype=bool)
    repeated[order], leads[order] = many[run], os == first[run]
    return h, repeated, leads, lengths


def _filter(keyed: DataFrame, min_words: int, buckets: int) -> np.ndarray:
    """A bitmap over the retained suffixes that have a neighbour in another document."""
    width = min_words - GRAM + 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, owners, n = WordHashes(), [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, least, several, _ = _entries(np.concatenate(held), np.repeat(np.array(owners, dtype=np.int64), [len(x) for x in held]))
            for row in _questions("", h, least, several, buckets):
                yield pa.RecordBatch.from_pylist([row], _ASK)

        for batch in _slices(batches):
            for owner, text in zip(batch.column(1).to_pylist(), batch.column(3).cast(pa.binary()).to_pylist(), strict=True):
                words = text.split() if text else []
                if len(words) >= min_words:
                    grams = gram_hashes(hashes.array(words), GRAM)
                    held.append(grams[np.unique(minimisers(grams, width))])
                    owners.append(owner)
                    n += len(held[-1])
                    if n >= BATCH_ENTRIES:
                        yield from flush()
                        held, owners, n = [], [], 0
        if held:
            yield from flush()

    def bits(table: pa.Table) -> pa.Table:
        h, repeated, _, _ = _resolve(table.to_pylist())
        at = np.unique(h[repeated] % np.uint64(FILTER_BITS)).astype(np.int64)
        words = np.unique(at >> 6)
        values = np.zeros(len(words), dtype=np.uint64)
        np.bitwise_or.at(values, np.searchsorted(words, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        return pa.table({"word": pa.array(words), "bits": pa.array(values.view(np.int64))})

    found = keyed.mapInArrow(trimmed(ask), _ASK_DDL).groupBy("bucket").applyInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    bitmap[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bitmap


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of True."""
    edges = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _joined(starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``size`` words at ascending starts, joined where they overlap or touch."""
    new = np.concatenate(([True], starts[1:] > starts[:-1] + size))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return starts[first], starts[last] + size


def repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """One row per span: doc_id, key (a hash of the text), start_word, end_word (exclusive), copy. Spans with copy =
    false are the passages that another document has too; those with copy = true are the parts of them that a document
    with a smaller id has."""
    require(docs, "doc_id", "text")
    spark = docs.sparkSession
    buckets = buckets_for(spark, docs)
    key = F.xxhash64("text")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(key, 2) + F.lit(1 << 61)).alias("owner"), key.alias("key"), "text")
    bitmap = spark.sparkContext.broadcast(_filter(keyed, min_words, buckets))
    width = min_words - GRAM + 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        hashes, windows, turn = WordHashes(), Windows(min_words), 0
        held: list[tuple] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal turn
            name = uuid.uuid4().hex
            owner = np.repeat(np.array([x[1] for x in held], dtype=np.int64), [len(x[4]) for x in held])
            h, least, several, where = _entries(np.concatenate([x[4] for x in held]), owner)
            at = np.cumsum([0] + [len(x[4]) for x in held])
            place = pa.RecordBatch.from_pylist([{"doc_id": x[0], "owner": x[1], "key": x[2], "starts": x[3].astype(np.int32).tobytes(), "where": where[at[i] : at[i + 1]].astype(np.int32).tobytes()} for i, x in enumerate(held)], pa.schema([("doc_id", pa.int64()), ("owner", pa.int64()), ("key", pa.int64()), ("starts", pa.binary()), ("where", pa.binary())]))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, place.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(place)
            turn += 1
            yield pa.RecordBatch.from_pylist([{"kind": 0, "bucket": turn % buckets, "batch": name, "hashes": least.tobytes(), "place": sink.getvalue().to_pybytes()}], _ASK)
            for row in _questions(name, h, least, several, buckets):
                yield pa.RecordBatch.from_pylist([row], _ASK)

        for batch in _slices(batches):
            for doc_id, owner, text_key, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3).cast(pa.binary()).to_pylist(), strict=True):
                words = text.split() if text else []
                if len(words) < min_words:
                    continue
                h = hashes.array(words)
                grams = gram_hashes(h, GRAM)
                slot = (grams % np.uint64(FILTER_BITS)).astype(np.int64)
                shared = (bitmap.value[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
                if not shared.any():
                    continue
                starts = np.flatnonzero(shared[minimisers(grams, width)])
                if len(starts):
                    held.append((doc_id, owner, text_key, starts, windows.hashes(h)[starts]))
                    n += len(starts)
                    if n >= BATCH_ENTRIES:
                        yield from flush()
                        held, n = [], 0
        if held:
            yield from flush()

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = [{"kind": 0, "bucket": r["bucket"], "batch": r["batch"], "hashes": r["hashes"], "place": r["place"]} for r in rows if r["kind"] == 0]
        asked = [r for r in rows if r["kind"] == 1]
        if asked:
            _, repeated, leads, lengths = _resolve(asked)
            at = 0
            for r, n in zip(asked, lengths, strict=True):
                out.append({"kind": 1, "bucket": r["bucket"], "batch": r["batch"], "hashes": np.packbits(repeated[at : at + n]).tobytes(), "owners": np.packbits(leads[at : at + n]).tobytes(), "several": np.int64(n).tobytes()})
                at += n
        trim()
        return pa.Table.from_pylist(out, _ASK)

    answered = materialise(keyed.mapInArrow(trimmed(ask), _ASK_DDL).groupBy("bucket").applyInArrow(answer, _ASK_DDL), "suffix-answers")

    def finish(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        replies = sorted((r for r in rows if r["kind"] == 1), key=lambda r: r["bucket"])
        lengths = [int(np.frombuffer(r["several"], dtype=np.int64)[0]) for r in replies]
        unpack = lambda name: np.concatenate([np.unpackbits(np.frombuffer(r[name], dtype=np.uint8), count=n) for r, n in zip(replies, lengths, strict=True)]).astype(bool)
        repeated, leads = unpack("hashes"), unpack("owners")
        place = next(r for r in rows if r["kind"] == 0)
        least = np.frombuffer(place["hashes"], dtype=np.int64)
        out: list[tuple] = []
        for doc in pa.ipc.open_stream(place["place"]).read_all().to_pylist():
            starts, where = np.frombuffer(doc["starts"], dtype=np.int32).astype(np.int64), np.frombuffer(doc["where"], dtype=np.int32)
            again = repeated[where]
            copied = again & ~(leads[where] & (least[where] == doc["owner"]))
            for copy, mask in ((False, again), (True, copied)):
                if mask.any():
                    out += [(doc["doc_id"], doc["key"], a, b, copy) for a, b in zip(*(x.tolist() for x in _joined(starts[mask], min_words)), strict=True)]
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("doc_id", "key", "start_word", "end_word", "copy"), columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)})

    return answered.groupBy("batch").applyInArrow(finish, "doc_id long, key long, start_word long, end_word long, copy boolean").distinct()


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of the spans, and without the white space inside them."""
    words = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for first, last in sorted(spans):
        out.append(text[at : words[first][0]])
        at = words[last - 1][1]
    return b"".join([*out, text[at:]])


def without_copies(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``docs`` without passages that a document with a smaller id has; documents of which no word is left go, and
    ``n_chars``, where it is a column, is the new length."""
    spans = repeats(docs, min_words).where("copy")
    spans = materialise(spans.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start_word", "end_word")).alias("__spans")), "suffix-spans")
    spans = spans.select(F.col("doc_id").alias("__doc"), F.col("key").alias("__key"), "__spans")
    if spans.count() <= BROADCAST_DOCS:
        spans = F.broadcast(spans)
    names, counted = docs.columns, "n_chars" in docs.columns
    joined = docs.join(spans, docs["doc_id"].cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64(docs["text"]) == F.col("__key")), "left").drop("__doc", "__key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(batch.schema.get_field_index("__spans"))
            batch = batch.select(names)
            if spans.null_count < len(spans):
                k = names.index("text")
                texts = batch.column(k).cast(pa.binary()).to_pylist()
                cuts = [cut(t, [(s["start_word"], s["end_word"]) for s in own]) if own else t for t, own in zip(texts, spans.to_pylist(), strict=True)]
                columns = list(batch.columns)
                columns[k] = pa.array(cuts, pa.binary()).cast(batch.schema.field(k).type)
                if counted:
                    j = names.index("n_chars")
                    columns[j] = pa.array([len(t.decode()) if own else n for t, own, n in zip(cuts, spans.to_pylist(), columns[j].to_pylist(), strict=True)], batch.schema.field(j).type)
                batch = pa.RecordBatch.from_arrays(columns, names).filter(pa.array([not own or bool(t.split()) for t, own in zip(cuts, spans.to_pylist(), strict=True)], pa.bool_()))
            yield batch

    return joined.mapInArrow(run, docs.schema)
