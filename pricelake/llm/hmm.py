"""Language-model scoring with a hidden Markov model.

Tokens are words, and one end per document. Frequent words are symbols of their own; the other words fall into symbol
classes by their ending, and inside a class a word has its smoothed share (count + 1), with one share left for words
never seen. So the model is a distribution over all token sequences, while its alphabet stays bounded.

Baum-Welch runs over all training documents: every pass computes the expected counts of its partition's documents (cut
into runs of at most ``RUN`` tokens, each a training sequence) and adds them up across partitions; the driver sees sums
of fixed size. Scoring is the scaled forward recursion over each whole document, many documents side by side.

Word counts are kept as 64-bit hashes of words, packed per bucket of the hash range. Frequent words come from the counts
(a bounded top list); the counts of all other words reach the documents by a packed exchange: a batch of documents asks
each bucket once for the words it holds, and adds the answers up. Nothing that grows with the vocabulary is broadcast.

Null texts count as empty (one end token); ids may be null or repeat (rows are numbered internally); a corpus without
training tokens gives every token the chance of an unseen word; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, materialise, require, text_hash, trimmed
from .words import WordHashes, mixed

#: Words that are symbols of their own, and classes for all others.
FREQUENT_WORDS = 12_000
ENDING_CLASSES = 512
RUN = 128
#: Tokens that a task counts, or whose documents it sends, at once.
CHUNK = 2_000_000
_END = np.uint64(0x0E4D)
_LOG10 = np.log(10.0)


def _ending_class(word: bytes) -> int:
    """Class of a word that isn't frequent: by its last bytes, and by whether it holds capitals, digits or marks."""
    core = word.rstrip(b".,;:!?")
    kind = 1 if core.isalpha() or core.isascii() is False else 2 if core.isalnum() else 3
    return xxhash.xxh3_64_intdigest(core[-2:] + bytes([kind, min(len(core), 12) // 3, len(word) > len(core)])) % ENDING_CLASSES


def _words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def _word_id(word: bytes) -> int:
    """A word's hash whose low bits are its ending class, so that the class is known where the word isn't."""
    h = xxhash.xxh3_64_intdigest(word)
    return (h - h % 1024 + _ending_class(word)) % (1 << 64)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def _split(h: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's stretch begins and ends in the sorted ``h``."""
    return np.searchsorted(_bucket(h, buckets), np.arange(buckets + 1))


def count_words(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, hashes, counts) of the training documents' words, one row per bucket, hashes ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, n = WordHashes(of=_word_id), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, counts = np.unique(np.concatenate(held), return_counts=True)
            edges = _split(h, buckets)
            for b in range(buckets):
                if edges[b] < edges[b + 1]:
                    own = slice(edges[b], edges[b + 1])
                    yield pa.RecordBatch.from_pydict({"bucket": [b], "hashes": [h[own].tobytes()], "counts": [counts[own].astype(np.int64).tobytes()]}, pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())]))

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                own = ids.array(_words(text))
                if len(own):
                    held.append(own)
                    n += len(own)
                    if n >= CHUNK:
                        yield from flush()
                        held, n = [], 0
        if held:
            yield from flush()

    def merge(table: pa.Table) -> pa.Table:
        h = np.frombuffer(b"".join(table.column("hashes").to_pylist()), dtype=np.uint64)
        c = np.frombuffer(b"".join(table.column("counts").to_pylist()), dtype=np.int64)
        order = np.argsort(h, kind="stable")
        h, c = h[order], c[order]
        starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "hashes": pa.array([h[starts].tobytes()], pa.binary()), "counts": pa.array([np.add.reduceat(c, starts).tobytes()], pa.binary())})

    schema = "bucket int, hashes binary, counts binary"
    return materialise(docs.select("text").mapInArrow(trimmed(run), schema).groupBy("bucket").applyInArrow(merge, schema), "lm-counts")


def totals(counts: DataFrame) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, distinct, frequent hashes, their counts, per class sum of count + 1 over the words that aren't frequent)."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hs, cs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                h, c = np.frombuffer(hs, dtype=np.uint64), np.frombuffer(cs, dtype=np.int64)
                best = np.lexsort((h, -c))[:FREQUENT_WORDS]
                yield pa.RecordBatch.from_arrays([pa.array(h[best].view(np.int64)), pa.array(c[best])], ["h", "c"])

    best = counts.mapInArrow(top, "h long, c long").orderBy(F.desc("c"), "h").limit(FREQUENT_WORDS).collect()
    frequent = np.array([r["h"] for r in best], dtype=np.int64).view(np.uint64)
    order = np.argsort(frequent)
    frequent = frequent[order]
    frequent_counts = np.array([r["c"] for r in best], dtype=np.int64)[order]

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, tokens, distinct = np.zeros(ENDING_CLASSES, dtype=np.int64), 0, 0
        for batch in batches:
            for hs, cs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                h, c = np.frombuffer(hs, dtype=np.uint64), np.frombuffer(cs, dtype=np.int64)
                tokens, distinct = tokens + int(c.sum()), distinct + len(h)
                rare = ~_member(frequent, h)[0]
                np.add.at(sums, (h[rare] % np.uint64(1024)).astype(np.int64), c[rare] + 1)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *range(ENDING_CLASSES)]), pa.array([tokens, distinct, *sums.tolist()])], ["k", "v"])

    found = {r["k"]: r["v"] for r in counts.mapInArrow(rest, "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    return found.get(-2, 0), found.get(-1, 0), frequent, frequent_counts, np.array([found.get(k, 0) for k in range(ENDING_CLASSES)], dtype=np.int64)


def _member(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is it there, where)."""
    if not len(sorted_values):
        return np.zeros(len(x), dtype=bool), np.zeros(len(x), dtype=np.int64)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x, at


class Hmm:
    """Start, transition and emission chances of ``k`` states over ``m`` symbols."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.start, self.step, self.emit = start, step, emit

    @staticmethod
    def initial(states: int, weights: np.ndarray, seed: int = 7) -> Hmm:
        """Emissions near the symbols' shares, each state leaning to its own random symbols; states tend to stay."""
        rng = np.random.default_rng(seed)
        emit = weights * np.exp(1.0 * rng.standard_normal((states, len(weights))))
        step = np.full((states, states), 0.2 / max(1, states - 1))
        np.fill_diagonal(step, 0.8 if states > 1 else 1.0)
        return Hmm(np.full(states, 1 / states), step, emit / emit.sum(axis=1, keepdims=True))

    @staticmethod
    def from_counts(start: np.ndarray, step: np.ndarray, emit: np.ndarray, prior: np.ndarray) -> Hmm:
        """Maximisation; ``prior`` (pseudo-counts per symbol) keeps every symbol possible in every state."""
        start, step, emit = start + 1.0, step + 1.0, emit + prior
        return Hmm(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))

    def log_likelihoods(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Natural logarithms of the chances of whole sequences, by the scaled forward recursion."""
        order = np.argsort([-len(s) for s in sequences], kind="stable")
        lengths = np.array([len(sequences[i]) for i in order])
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        flat = np.concatenate([sequences[i] for i in order]).astype(np.int64) if len(order) else np.empty(0, dtype=np.int64)
        by_symbol = np.ascontiguousarray(self.emit.T)
        logs, n = np.zeros(len(order)), len(order)
        alpha = None
        active = n
        for t in range(int(lengths[0]) if n else 0):
            while active and lengths[active - 1] <= t:
                active -= 1
            b = by_symbol[flat[offsets[:active] + t]]
            alpha = self.start * b if t == 0 else (alpha[:active] @ self.step) * b
            scale = alpha.sum(axis=1)
            alpha /= scale[:, None]
            logs[:active] += np.log(scale)
        out = np.empty(n)
        out[order] = logs
        return out

    def expected_counts(self, runs: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Forward-backward over padded runs (sorted, longest first): counts of starts, steps, emissions; log likelihood."""
        k, (n, width) = len(self.start), runs.shape
        by_symbol = np.ascontiguousarray(self.emit.T)
        alphas, scales, emitted = [], [], []
        active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(width)]  # lengths > t
        alpha = None
        for t in range(width):
            if not active[t]:
                break
            b = by_symbol[runs[: active[t], t]]
            alpha = self.start * b if t == 0 else (alpha[: active[t]] @ self.step) * b
            scale = alpha.sum(axis=1)
            alpha = alpha / scale[:, None]
            alphas.append(alpha)
            scales.append(scale)
            emitted.append(b)
        step, emit = np.zeros((k, k)), np.zeros((len(by_symbol), k))
        beta = np.ones((0, k))
        symbols, gammas = [], []
        for t in range(len(alphas) - 1, -1, -1):
            full = np.ones((active[t], k))
            if t + 1 < len(alphas):
                m = active[t + 1]
                after = emitted[t + 1] * beta / scales[t + 1][:, None]
                step += self.step * (alphas[t][:m].T @ after)
                full[:m] = after @ self.step.T
            beta = full
            gammas.append(alphas[t] * beta)
            symbols.append(runs[: active[t], t])
        gamma, symbol = np.concatenate(gammas), np.concatenate(symbols)
        for j in range(k):
            emit[:, j] = np.bincount(symbol, weights=gamma[:, j], minlength=len(by_symbol))
        return gammas[-1].sum(axis=0), step, emit.T, float(sum(np.log(s).sum() for s in scales))


def _pad(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Cut into runs, longest first, padded with zeros."""
    runs = [s[i : i + RUN] for s in sequences for i in range(0, len(s), RUN)]
    runs.sort(key=len, reverse=True)
    lengths = np.array([len(r) for r in runs])
    out = np.zeros((len(runs), RUN), dtype=np.int64)
    for i, r in enumerate(runs):
        out[i, : len(r)] = r
    return out, lengths


def encode(docs: DataFrame, frequent: np.ndarray, log_frequent: np.ndarray, buckets: int) -> DataFrame:
    """Packed documents, written once: rows of kind 0, one per batch of documents (their ids, folds, lengths, symbols
    and what is known of frequent words), and rows of kind 1, the batch's questions to each bucket."""
    spark = docs.sparkSession
    words = spark.sparkContext.broadcast((frequent, log_frequent))
    end = FREQUENT_WORDS + ENDING_CLASSES
    schema = "kind int, batch string, bucket int, doc_ids array<bigint>, held_out array<boolean>, lengths binary, symbols binary, known binary, logs binary, hashes binary, owners binary"
    out = pa.schema([("kind", pa.int32()), ("batch", pa.string()), ("bucket", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), *[(n, pa.binary()) for n in ("lengths", "symbols", "known", "logs", "hashes", "owners")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        ids = WordHashes(of=_word_id)
        often, logs = words.value
        doc_ids, folds, hashes, n = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            name = uuid.uuid4().hex
            lengths = np.fromiter(map(len, hashes), dtype=np.int64, count=len(hashes))
            h = np.concatenate(hashes)
            owner = np.repeat(np.arange(len(hashes)), lengths)
            is_often, at = _member(often, h)
            symbols = np.where(is_often, at, FREQUENT_WORDS + (h % np.uint64(1024)).astype(np.int64))
            with_end = np.insert(symbols, np.cumsum(lengths), end).astype(np.uint16)
            known = np.bincount(owner[is_often], minlength=len(hashes))
            sums = np.bincount(owner[is_often], weights=logs[at[is_often]], minlength=len(hashes))
            yield pa.RecordBatch.from_pylist([{"kind": 0, "batch": name, "doc_ids": doc_ids, "held_out": folds, "lengths": (lengths + 1).tobytes(), "symbols": with_end.tobytes(), "known": known.astype(np.int64).tobytes(), "logs": sums.tobytes()}], out)
            asked, owner = h[~is_often], owner[~is_often]
            order = np.argsort(asked, kind="stable")
            asked, owner = asked[order], owner[order]
            edges = _split(asked, buckets)
            for b in range(buckets):
                if edges[b] < edges[b + 1]:
                    own = slice(edges[b], edges[b + 1])
                    yield pa.RecordBatch.from_pylist([{"kind": 1, "batch": name, "bucket": b, "hashes": asked[own].tobytes(), "owners": owner[own].astype(np.int32).tobytes(), "lengths": np.int64(len(hashes)).tobytes()}], out)

        for batch in batches:
            for doc_id, fold, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                doc_ids.append(doc_id)
                folds.append(fold)
                hashes.append(ids.array(_words(text)))
                n += len(hashes[-1])
                if n >= CHUNK:
                    yield from flush()
                    doc_ids, folds, hashes, n = [], [], [], 0
        if doc_ids:
            yield from flush()

    return materialise(docs.mapInArrow(trimmed(run), schema), "lm-docs", ["kind"])


def _sequences(row: dict, training_only: bool) -> list[np.ndarray]:
    lengths = np.frombuffer(row["lengths"], dtype=np.int64)
    symbols = np.frombuffer(row["symbols"], dtype=np.uint16)
    parts = np.split(symbols, np.cumsum(lengths)[:-1])
    return [s for s, held in zip(parts, row["held_out"], strict=True) if not held] if training_only else parts


def train(packed: DataFrame, states: int, passes: int, weights: np.ndarray) -> Hmm:
    """Baum-Welch over all training documents; each pass adds up the expected counts of all partitions."""
    spark = packed.sparkSession
    shares = (weights + 1.0) / (weights + 1.0).sum()
    model = Hmm.initial(states, shares)
    m = len(weights)
    for _ in range(passes):
        sent = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            start, step, emit, loss = np.zeros(states), np.zeros((states, states)), np.zeros((states, m)), 0.0
            for batch in batches:
                for row in batch.to_pylist():
                    runs, lengths = _pad(_sequences(row, True))
                    for at in range(0, len(runs), 2048):
                        s, x, e, ll = sent.value.expected_counts(runs[at : at + 2048], lengths[at : at + 2048])
                        start, step, emit, loss = start + s, step + x, emit + e, loss + ll
            # One row per block of the counts: sums over partitions are taken by Spark.
            rows = [(-2, [loss]), (-1, [*start, *step.ravel()])] + [(i, emit[:, i : i + 256].ravel()) for i in range(0, m, 256)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([np.asarray(r[1], dtype=float) for r in rows], pa.list_(pa.float64()))], ["block", "counts"])

        def add(table: pa.Table) -> pa.Table:
            total = np.sum([np.asarray(x.as_py()) for x in table.column("counts")], axis=0)
            return pa.table({"block": table.column("block").slice(0, 1), "counts": pa.array([total], pa.list_(pa.float64()))})

        schema = "block long, counts array<double>"
        found = {r["block"]: np.array(r["counts"]) for r in packed.select("lengths", "symbols", "held_out").mapInArrow(run, schema).groupBy("block").applyInArrow(add, schema).collect()}
        sent.unpersist()
        if not found:
            return model
        start, step = found[-1][:states], found[-1][states:].reshape(states, states)
        emit = np.concatenate([found[i].reshape(states, -1) for i in range(0, m, 256)], axis=1)
        model = Hmm.from_counts(start, step, emit, shares * 50.0)
    return model


def score(docs: DataFrame, states: int = 6, passes: int = 4) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    require(docs, "doc_id", "text")
    spark = docs.sparkSession
    buckets = buckets_for(spark, docs)
    folded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text_hash("doc_id") % 7 == 2, F.lit(False)).alias("held_out"), "text")
    training = folded.where(~F.col("held_out"))
    counts = count_words(training, buckets)
    n_words, distinct, frequent, frequent_counts, class_sums = totals(counts)
    ends = training.count()
    tokens, vocabulary = n_words + ends, distinct + (ends > 0)
    packed = encode(folded, frequent, np.log10(frequent_counts + 1.0), buckets)
    documents, questions = packed.where("kind = 0"), packed.where("kind = 1")
    weights = np.zeros(FREQUENT_WORDS + ENDING_CLASSES + 1)
    weights[: len(frequent)] = frequent_counts
    weights[FREQUENT_WORDS:-1] = class_sums
    weights[-1] = ends
    model = spark.sparkContext.broadcast(train(documents, states, passes, weights))
    # A word's share of its class is (count + 1) / (sum over the class of count + 1, and 1 for all unseen words).
    shares = spark.sparkContext.broadcast(np.log10(class_sums + 1.0))

    def answer(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """Of each question: per document, the sum of log10(count + 1), how many words are known."""
        h = np.frombuffer(right.column("hashes")[0].as_py(), dtype=np.uint64) if right.num_rows else np.empty(0, dtype=np.uint64)
        c = np.frombuffer(right.column("counts")[0].as_py(), dtype=np.int64) if right.num_rows else np.empty(0, dtype=np.int64)
        names, whos, sums, known = [], [], [], []
        for row in left.select(["batch", "hashes", "owners"]).to_pylist():
            there, at = _member(h, np.frombuffer(row["hashes"], dtype=np.uint64))
            who, inverse = np.unique(np.frombuffer(row["owners"], dtype=np.int32), return_inverse=True)
            found = np.where(there, c[at], 0) if len(c) else np.zeros(len(at), dtype=np.int64)
            names.append(row["batch"])
            whos.append(who.tobytes())
            sums.append(np.bincount(inverse, weights=np.log10(found + 1.0)).tobytes())
            known.append(np.bincount(inverse, weights=there).astype(np.int64).tobytes())
        return pa.table({"batch": pa.array(names, pa.string()), "who": pa.array(whos, pa.binary()), "sums": pa.array(sums, pa.binary()), "known": pa.array(known, pa.binary())})

    asked = questions.select(F.col("bucket"), "batch", "hashes", "owners").groupBy("bucket")
    answers = asked.cogroup(counts.groupBy("bucket")).applyInArrow(answer, "batch string, who binary, sums binary, known binary")

    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, held, n_tokens, n_known, base, scores = [], [], [], [], [], []
        replies = right.to_pylist()
        for row in left.to_pylist():
            lengths = np.frombuffer(row["lengths"], dtype=np.int64)
            known, logs = np.frombuffer(row["known"], dtype=np.int64).copy(), np.frombuffer(row["logs"], dtype=float).copy()
            rare_logs = np.zeros(len(lengths))
            for reply in replies:
                who = np.frombuffer(reply["who"], dtype=np.int32)
                rare_logs[who] += np.frombuffer(reply["sums"], dtype=float)
                known[who] += np.frombuffer(reply["known"], dtype=np.int64)
            sequences = _sequences(row, False)
            inside = np.zeros(len(lengths))
            flat, owner = np.concatenate(sequences).astype(np.int64), np.repeat(np.arange(len(lengths)), lengths)
            rare = (flat >= FREQUENT_WORDS) & (flat < FREQUENT_WORDS + ENDING_CLASSES)
            inside -= np.bincount(owner[rare], weights=shares.value[flat[rare] - FREQUENT_WORDS], minlength=len(lengths))
            likelihood = model.value.log_likelihoods(sequences) / _LOG10
            ids += row["doc_ids"]
            held += row["held_out"]
            n_tokens.append(lengths)
            n_known.append(known + (ends > 0))
            base.append(logs + rare_logs + np.log10(ends + 1.0) - lengths * np.log10(tokens + vocabulary + 1.0))
            scores.append(likelihood + inside + rare_logs)
        join = lambda parts: np.concatenate(parts) if parts else np.empty(0)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(held, pa.bool_()), "n_tokens": pa.array(join(n_tokens), pa.int64()), "n_known": pa.array(join(n_known), pa.int64()), "train_tokens": pa.array(np.full(len(ids), tokens), pa.int64()), "base_score": pa.array(join(base), pa.float64()), "score": pa.array(join(scores), pa.float64())})

    return (
        documents.select("batch", "doc_ids", "held_out", "lengths", "symbols", "known", "logs")
        .groupBy("batch")
        .cogroup(answers.groupBy("batch"))
        .applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    )
