"""N-gram Jaccard join by PartEnum signatures.

Documents are sets of hashed word n-grams; two link when their Jaccard similarity reaches a bound. Sets whose sizes
differ too much can't link, so sizes are cut into bands that grow by that ratio, and a set takes part in the instance of
its own band and of the next. In an instance, linked sets differ in at most k n-grams. PartEnum cuts the n-gram domain into
n1 parts and each part into n2 smaller ones, and enumerates the subsets of n2 - k2 smaller parts of each part: a signature
is the hash of a set's n-grams in one subset. Of n1 parts at most k / (k2 + 1) hold more than k2 of the differences, so with
more parts than that, linked sets agree on a whole subset of at least one part and share its signature. A subset that is
empty in both says nothing, so an instance has enough parts that more than k / (k2 + 1) have no empty subset; a set for
which that fails emits its empty subsets as well, which keeps the join exact.

A signature that many sets of a batch share is often one frequent n-gram, which says little; a set leaves the parts of such
signatures out, but never more than half of those it has beyond the bound, so that of two linked sets at least one common
part is emitted by both.

Signatures travel packed, a row for each batch of documents and bucket of signatures, and are sorted per bucket. Sets
that share one form candidate groups. A signature that is frequent within one batch leaves as plain rows, so that no task
has to hold its members. Groups are never expanded into all pairs:

1. Each set is compared with the least member it met, on the texts. That settles true clusters in linear time.
2. Groups that still span several clusters are cut into blocks of bounded size, and members of different clusters are
   compared by bit sketches: bit i is the parity of a set's n-grams in cell i, so two sketches differ in at most as many
   bits as the sets in n-grams, and a pair that differs in more than k bits can't link. A block returns at most one row for
   each of its sets: which region of not excluded pairs it lies in.
3. A region is cut into blocks in turn, now with the sets themselves. Members of different clusters are compared exactly,
   nearest first, and a block returns the links that join clusters, at most one for each of its sets.

So no link between clusters is lost, and no stage returns more than a row for each set and block.

Equal sets are one class from the start. Null and word-less texts have no n-grams and link with nothing; texts with
fewer words than n are one n-gram; texts of any length are one set, and longer ones only make blocks of fewer sets; null ids
never become a component's id unless all are null; repeated rows are repeated in the result; an empty table gives an empty
result; other columns, whatever their names, are ignored by :func:`join` and kept by :func:`one_of_each`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, discard, materialise, require, trim, trimmed
from .components import components
from .words import WordHashes, gram_hashes, mixed

#: Signatures that a batch holds before it is sent.
BATCH_SIGNATURES = 600_000
#: A signature in so many sets of one batch leaves as plain rows.
FREQUENT = 64
#: Bits of the filter that spares texts without candidates a shuffle; it only lets more through when it is full.
MOST_FILTER_BITS = 1 << 24
#: Ids of documents to drop are broadcast up to so many; beyond, documents are joined by shuffle.
BROADCAST_IDS = 500_000
#: Sets of a block of a candidate group or region, about; sets of more n-grams than a share count as several.
BLOCK, SHARE = 512, 256
#: Parts are cut a second time, into n2 of which all but k2 have to agree, where that takes so many times the signatures at most.
SECOND, DEARER = (3, 1), 1.75
#: A signature travels as so many low bits, besides its bucket.
_LOW = np.uint64(40)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _parts(low: int, most: int, n2: int, k2: int) -> int:
    """The least n1 for which a set of ``low`` n-grams nearly always has more than ``most`` parts without empty subsets."""
    n1 = most + 1
    while most and n1 < 4 * most + 16:
        load = low / (n1 * n2)
        bare = math.exp(-load)  # chance that a smaller part is empty
        short = sum(math.comb(n2, j) * bare**j * (1 - bare) ** (n2 - j) for j in range(n2 - k2, n2 + 1))
        spread = 4 * math.sqrt(n1 * bare * max(0.0, 1 - (1 + load) * bare)) if n2 == 1 else 2 * math.sqrt(n1 * short * (1 - short))
        if n1 * (1 - short) - spread >= most + 1:
            break
        n1 += 1
    return n1


class Bands:
    """Size bands and the parts of each instance, for a similarity of ``num / den``."""

    def __init__(self, num: int = 4, den: int = 5):
        self.num, self.den = num, den
        self.bounds = [(1, den // num)]

    def of(self, size: int) -> int:
        while self.bounds[-1][1] < size:
            low = self.bounds[-1][1] + 1
            self.bounds.append((low, low * self.den // self.num))
        return next(i for i, (_, high) in enumerate(self.bounds) if size <= high)

    @cache  # noqa: B019  one object per worker
    def parts(self, instance: int) -> tuple[int, np.ndarray, int, np.ndarray]:
        """(n1, subsets, most, names) of the instance for sizes of the bands ``instance - 1`` and ``instance``: a row of
        ``subsets`` says which smaller parts of a part are in it, ``most`` is how many parts may disagree on all
        subsets, ``names`` tells subsets of different parts apart."""
        while len(self.bounds) <= instance:
            self.of(self.bounds[-1][1] + 1)
        low, high = self.bounds[max(0, instance - 1)][0], self.bounds[instance][1]
        # |A xor B| <= (1 - s) / (1 + s) * (|A| + |B|) for s = num / den
        k = (self.den - self.num) * 2 * high // (self.den + self.num)
        n2, k2 = SECOND
        n1, once = _parts(low, k // (k2 + 1), n2, k2), _parts(low, k, 1, 0)
        if n1 * math.comb(n2, k2) > DEARER * once:  # few n-grams, so many empty subsets
            n1, n2, k2 = once, 1, 0
        most = k // (k2 + 1)
        subsets = np.array([[j in own for j in range(n2)] for own in combinations(range(n2), n2 - k2)], dtype=np.uint64)
        names = mixed((np.uint64(instance) << np.uint64(40)) + np.arange(1, n1 * len(subsets) + 1, dtype=np.uint64)).reshape(n1, -1)
        return n1, subsets, most, names


def gram_set(words: list[bytes], hashes: WordHashes, n: int) -> np.ndarray:
    """The sorted distinct hashes of a document's n-grams."""
    h = hashes.array(words)
    if not len(h):
        return h
    if len(h) < n:
        return gram_hashes(np.append(h, np.uint64(len(h))), len(h) + 1)
    return np.unique(gram_hashes(h, n))


def signed_parts(grams: np.ndarray, bands: Bands) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Of both instances: the signatures of all subsets that aren't empty (and of empty ones, where too few parts have
    none), the part of each, ascending, and how many parts may be left out."""
    own = bands.of(len(grams))
    weights, high = mixed(grams + _GOLD), grams >> np.uint64(32)
    out = []
    for instance in (own, own + 1):
        n1, subsets, most, names = bands.parts(instance)
        n2 = subsets.shape[1]
        cell = high * np.uint64(n1 * n2) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        sums, there = np.zeros(n1 * n2, dtype=np.uint64), np.zeros(n1 * n2, dtype=np.uint64)
        sums[cell[starts]], there[cell[starts]] = np.add.reduceat(weights, starts), 1
        found = mixed(sums.reshape(n1, n2) @ subsets.T ^ names)
        emitted = there.reshape(n1, n2) @ subsets.T > 0
        full = int(emitted.all(axis=1).sum())
        if full <= most:
            emitted[:] = True
        out.append((found[emitted], np.nonzero(emitted)[0], max(0, full - most - 1) // 2))
    return out


def signatures(grams: np.ndarray, bands: Bands) -> list[tuple[np.ndarray, int]]:
    """Of both instances: the signatures, and how many parts of them may be left out."""
    return [(found, spare) for found, _, spare in signed_parts(grams, bands)]


_OUT = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("values", pa.binary()), ("frequent", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("keys", pa.binary())])
_FOUND = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("d", pa.int64())])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _short(sigs: np.ndarray) -> bytes:
    """The low bits of signatures."""
    return sigs.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : int(_LOW) // 8].tobytes()


def _whole(values: bytes, bucket: int) -> np.ndarray:
    """Signatures of a bucket from their low bits."""
    low = np.frombuffer(values, dtype=np.uint8).reshape(-1, int(_LOW) // 8)
    out = np.zeros((len(low), 8), dtype=np.uint8)
    out[:, : low.shape[1]] = low
    return out.view("<u8")[:, 0] | (np.uint64(bucket) << _LOW)


def _emit(n: int, buckets: int, num: int, den: int):
    """Documents -> rows of kind 0 (their ids, keys, classes and sizes) and 1 (signatures), 2 (frequent signatures)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bands, turn = WordHashes(), Bands(num, den), 0
        seen: set[int] = set()

        def flush(ids: list[int], sets: list[list[tuple[np.ndarray, np.ndarray, int]]]) -> Iterator[dict]:
            nonlocal turn
            sids = np.array(ids, dtype=np.uint64)
            pieces = [(i, *one) for i, own in enumerate(sets) for one in own]
            lengths = np.fromiter((len(found) for _, found, _, _ in pieces), dtype=np.int64, count=len(pieces))
            sigs, owner = np.concatenate([found for _, found, _, _ in pieces]), np.repeat(np.array([i for i, *_ in pieces]), lengths)
            bucket = (sigs >> _LOW) * np.uint64(buckets) >> np.uint64(24)
            sigs = (bucket << _LOW) | (sigs & ((np.uint64(1) << _LOW) - np.uint64(1)))
            order = np.argsort(sigs, kind="stable")
            ranked = sigs[order]
            starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
            sizes = np.diff(np.append(starts, len(ranked)))
            shared = np.empty(len(sigs), dtype=np.int64)
            shared[order] = np.repeat(sizes, sizes)
            drop = np.zeros(len(sigs), dtype=bool)
            at = np.cumsum(lengths) - lengths
            for j in np.flatnonzero(np.maximum.reduceat(shared, at) > 1):  # the most shared parts are left out, as many as may be
                _, _, part, spare = pieces[j]
                if spare:
                    own, of = shared[at[j] : at[j] + lengths[j]], np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                    worst = np.maximum.reduceat(own, of)
                    spare = min(spare, int((worst > 1).sum()))
                    gone = np.zeros(len(of), dtype=bool)
                    gone[np.argpartition(-worst, spare - 1)[:spare]] = True
                    drop[at[j] : at[j] + lengths[j]] = np.repeat(gone, np.diff(np.append(of, len(part))))
            order = order[~drop[order]]
            ranked = sigs[order]
            starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
            sizes = np.diff(np.append(starts, len(ranked)))
            hot = np.flatnonzero(sizes >= FREQUENT)
            frequent = ranked[starts[hot]]
            for j in hot:
                members = order[starts[j] : starts[j] + sizes[j]]
                drop[members[1:]] = True  # the first stays, so that other batches' members meet the group
                turn += 1
                yield {"kind": 2, "bucket": turn % buckets, "ids": np.unique(sids[owner[members]]).tobytes(), "values": ranked[starts[j]].tobytes()}
            sigs, owner = sigs[~drop], owner[~drop]
            order = np.argsort(sigs >> _LOW, kind="stable")
            edges = np.searchsorted(sigs[order] >> _LOW, np.arange(buckets + 1, dtype=np.uint64))
            first = np.searchsorted(frequent >> _LOW, np.arange(buckets + 1, dtype=np.uint64))
            for b in np.flatnonzero(np.diff(edges)).tolist():
                own = order[edges[b] : edges[b + 1]]
                who, counts = np.unique(owner[own], return_counts=True)
                yield {"kind": 1, "bucket": b, "ids": sids[who].tobytes(), "counts": counts.astype(np.uint32).tobytes(), "values": _short(sigs[own]), "frequent": frequent[first[b] : first[b + 1]].tobytes()}

        def rows() -> Iterator[dict]:
            nonlocal turn
            ids: list[int] = []
            sets: list[list[tuple[np.ndarray, np.ndarray, int]]] = []
            held = 0
            for whole in batches:
                for at in range(0, whole.num_rows, 2048):
                    batch = whole.slice(at, 2048)
                    classes, sizes = [], []
                    for text in batch.column(2).cast(pa.binary()).to_pylist():
                        grams = gram_set(text.lower().split() if text else [], hashes, n)  # bytes: A-Z only
                        sizes.append(len(grams))
                        sid = xxhash.xxh3_64_intdigest(grams.tobytes()) if len(grams) else 0
                        classes.append(sid)
                        if len(grams) and sid not in seen:
                            if len(seen) >= 200_000:
                                seen.clear()
                            seen.add(sid)
                            own = signed_parts(grams, bands)
                            ids.append(sid)
                            sets.append(own)
                            held += sum(len(found) for found, _, _ in own)
                            if held >= BATCH_SIGNATURES:
                                yield from flush(ids, sets)
                                ids, sets, held = [], [], 0
                    turn += 1
                    yield {"kind": 0, "bucket": turn % buckets, "doc_ids": batch.column(0).to_pylist(), "keys": np.asarray(batch.column(1)).tobytes(), "ids": np.array(classes, dtype=np.uint64).tobytes(), "counts": np.array(sizes, dtype=np.int64).tobytes()}
            if ids:
                yield from flush(ids, sets)

        for row in rows():
            yield pa.RecordBatch.from_pylist([row], _OUT)

    return run


def _meet(table: pa.Table) -> pa.Table:
    """A bucket's rows -> kind 0: (doc_id, key, class, size); kind 1: (group, class) of candidate groups."""
    found: list[pa.RecordBatch] = []

    def add(kind: int, a, b, c=None, d=None) -> None:
        nulls = pa.nulls(len(a), pa.int64())
        found.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, dtype=np.int32)), a, b, c if c is not None else nulls, d if d is not None else nulls], schema=_FOUND))

    all_ids, all_sigs, hot = [], [], []
    for batch in table.to_batches():
        for row in batch.to_pylist():
            ids = np.frombuffer(row["ids"], dtype=np.uint64)
            if row["kind"] == 0:
                add(0, pa.array(row["doc_ids"], pa.int64()), pa.array(np.frombuffer(row["keys"], dtype=np.int64)), _signed(ids), pa.array(np.frombuffer(row["counts"], dtype=np.int64)))
            elif row["kind"] == 2:
                sig = np.frombuffer(row["values"], dtype=np.uint64)
                add(1, _signed(np.repeat(mixed(sig), len(ids))), _signed(ids))
            else:
                all_ids.append(np.repeat(ids, np.frombuffer(row["counts"], dtype=np.uint32)))
                all_sigs.append(_whole(row["values"], row["bucket"]))
                hot.append(np.frombuffer(row["frequent"], dtype=np.uint64))
    if all_sigs:
        sigs, ids, hot_sigs = np.concatenate(all_sigs), np.concatenate(all_ids), np.unique(np.concatenate(hot))
        del all_sigs, all_ids
        order = np.argsort(sigs).astype(np.int32)
        sigs = sigs[order]
        same = sigs[1:] == sigs[:-1]
        met = np.concatenate((same, [False])) | np.concatenate(([False], same))
        sigs, ids = sigs[met], ids[order[met]]
        del order, same, met
        order = np.lexsort((ids, sigs))
        sigs, ids = sigs[order], ids[order]
        if len(sigs):
            new = np.concatenate(([True], (sigs[1:] != sigs[:-1]) | (ids[1:] != ids[:-1])))
            sigs, ids = sigs[new], ids[new]
            starts = np.flatnonzero(np.concatenate(([True], sigs[1:] != sigs[:-1])))
            sizes = np.diff(np.append(starts, len(sigs)))
            heads = sigs[starts]
            is_hot = np.isin(heads, hot_sigs)
            # Groups with the same members are one group.
            names = np.where(is_hot, mixed(heads), mixed(np.add.reduceat(mixed(ids + _GOLD), starts) + sizes.astype(np.uint64)))
            keep = np.zeros(len(starts), dtype=bool)
            keep[np.unique(names, return_index=True)[1]] = True
            keep &= (sizes > 1) | is_hot
            rows = np.repeat(keep, sizes)
            add(1, _signed(np.repeat(names, sizes)[rows]), _signed(ids[rows]))
        del sigs, ids
    trim()
    return pa.Table.from_batches(found, schema=_FOUND)


def bit_sketch(grams: np.ndarray, finer: int = 1) -> np.ndarray:
    """Parities of a set's n-grams in so many cells as the next power of two of its size (64 at least), times ``finer``,
    packed. A sketch of half as many cells is the XOR of the halves."""
    cells = max(64, 1 << max(0, len(grams) - 1).bit_length()) * finer
    return np.packbits(np.bincount((grams & np.uint64(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint8) & 1)


def _halved(sketches: np.ndarray) -> np.ndarray:
    half = sketches.shape[-1] // 2
    return sketches[..., :half] ^ sketches[..., half:]


def _sketched(n: int):
    """(class, text) -> (class, size, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                sets = [gram_set(t.lower().split(), hashes, n) for t in batch.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array([bit_sketch(x).tobytes() for x in sets], pa.binary())], ["class", "size", "sketch"])

    return run


def _survivors(group: np.ndarray, block: np.ndarray, root: np.ndarray, size: np.ndarray, sketches: list[bytes], one_block: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows (i, j, how far apart) with the same ``group`` (neighbours), in different clusters, that sizes and
    sketches can't rule out. Rows are compared at distances 1, 2, ... all at once, at the number of cells of the smaller
    one."""
    widths = np.array([len(x) for x in sketches])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        above = np.flatnonzero(widths == 2 * width)
        rows = np.concatenate((own, above))
        table = np.concatenate([np.frombuffer(b"".join(sketches[i] for i in own), dtype=np.uint8).reshape(-1, width), _halved(np.frombuffer(b"".join(sketches[i] for i in above), dtype=np.uint8).reshape(-1, 2 * width))])
        folded = np.concatenate((np.zeros(len(own), dtype=bool), np.ones(len(above), dtype=bool)))
        order = np.argsort(rows, kind="stable")
        rows, table, folded = rows[order], table[order], folded[order]
        g, b, r, s = group[rows], block[rows], root[rows], size[rows]
        apart = ~one_block[rows]
        step, left = 1, np.arange(len(rows) - 1)
        while len(left):
            left = left[left + step < len(rows)]
            left = left[g[left] == g[left + step]]
            right = left + step
            fits = (r[left] != r[right]) & ~(folded[left] & folded[right]) & (den * np.minimum(s[left], s[right]) >= num * np.maximum(s[left], s[right])) & (~apart[left] | (b[left] != b[right]))
            x, y = left[fits], right[fits]
            for at in range(0, len(x), 65_536):
                i, j = x[at : at + 65_536], y[at : at + 65_536]
                both = s[i] + s[j]
                differ = np.bitwise_count(table[i] ^ table[j]).sum(axis=1, dtype=np.int64)
                near = differ <= (den - num) * both // (den + num)
                found.append((rows[i[near]], rows[j[near]], 10_000 * differ[near] // both[near]))
            step += 1
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, dtype=np.int64),) * 3


def _near(num: int, den: int):
    """(a, b, size_a, size_b, sketch_a, sketch_b) -> (a, b) that sketches can't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, left, right in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                p, q = np.frombuffer(left, dtype=np.uint8), np.frombuffer(right, dtype=np.uint8)
                while len(p) > len(q):
                    p = _halved(p)
                while len(q) > len(p):
                    q = _halved(q)
                keep.append(int(np.bitwise_count(p ^ q).sum(dtype=np.int64)) <= (den - num) * (x + y) // (den + num))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows that come sorted by (group, low, high), in tables that hold whole pairs of blocks, with a key of each."""
    kept: pa.Table | None = None

    def keys(table: pa.Table) -> np.ndarray:
        parts = [table.column(n).to_numpy() for n in ("group", "low", "high")]
        return np.cumsum(np.concatenate(([True], np.logical_or.reduce([x[1:] != x[:-1] for x in parts]))))

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([kept, table]) if kept is not None and kept.num_rows else table
        key = keys(table) if table.num_rows else np.empty(0, dtype=np.int64)
        whole = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last one may go on
        if whole:
            yield table.slice(0, whole), key[:whole]
        kept = table.slice(whole)
    if kept is not None and kept.num_rows:
        yield kept, keys(kept)


class Union(dict):
    """Union-find; the least member stands for all."""

    def find(self, x: int) -> int:
        while (p := self.setdefault(x, x)) != x:
            self[x] = self[p]
            x = self[x]
        return x

    def join(self, a: int, b: int) -> bool:
        """Were they apart?"""
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)
        return a != b


def _labels(rows: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row that each row is connected with by pairs (i, j)."""
    label = np.arange(rows)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _regions(num: int, den: int):
    """Rows (group, low, high, block, class, root, size, sketch) of pairs of blocks -> edges (a, b) that connect the
    classes of different clusters which sketches can't rule out, at most one for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Union()
        for table, key in _pieces(batches):
            column = lambda n: table.column(n).to_numpy()  # noqa: B023, E731
            i, j, _ = _survivors(key, column("block"), column("root"), column("size"), table.column("sketch").to_pylist(), column("low") == column("high"), num, den)
            label, ids = _labels(table.num_rows, i, j), column("class")
            rows = np.flatnonzero(label != np.arange(len(label)))
            edges = [(a, b) for a, b in zip(ids[label[rows]].tolist(), ids[rows].tolist(), strict=True) if known.join(a, b)]
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])

    return run


def _within(num: int, den: int):
    """Rows (group, low, high, block, class, root, grams) of pairs of blocks -> links (a, b) that join clusters, by exact
    comparison, nearest pairs first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of = Union(), None
        for table, key in _pieces(batches):
            column = lambda n: table.column(n).to_numpy()  # noqa: B023, E731
            for k in np.unique(key):
                own = np.flatnonzero(key == k)
                piece = table.slice(int(own[0]), len(own))
                if (group := piece.column("group")[0].as_py()) != of:
                    known, of = Union(), group  # regions have no cluster in common
                sets = [np.frombuffer(x, dtype=np.uint64) for x in piece.column("grams").to_pylist()]
                sizes, ids, root = np.array(list(map(len, sets))), column("class")[own], column("root")[own].tolist()
                i, j, apart = _survivors(key[own], column("block")[own], column("root")[own], sizes, [bit_sketch(x, 4).tobytes() for x in sets], (column("low") == column("high"))[own], num, den)
                found = []
                for n in np.argsort(apart, kind="stable"):
                    x, y = int(i[n]), int(j[n])
                    if known.find(root[x]) == known.find(root[y]):
                        continue
                    both = _common(sets[x], sets[y])
                    if den * both >= num * (int(sizes[x] + sizes[y]) - both):
                        known.join(root[x], root[y])
                        found.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([int(f[side]) for f in found], pa.int64()) for side in (0, 1)], ["a", "b"])

    return run


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many members two sorted sets share."""
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def _grams(n: int):
    """(class, text) -> (class, grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = [gram_set(t.lower().split(), hashes, n).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["class", "grams"])

    return run


def _compare(n: int, num: int, den: int):
    """(a, b, text_a, text_b) -> (a, b) of those that link. Rows come sorted by a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        last: tuple[int | None, np.ndarray] = (None, np.empty(0, dtype=np.uint64))
        for batch in batches:
            keep = []
            for a, left, right in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary()), strict=True):
                if a != last[0]:
                    last = (a, gram_set(left.as_py().lower().split(), hashes, n))
                other = gram_set(right.as_py().lower().split(), hashes, n)
                both = _common(last[1], other)
                keep.append(den * both >= num * (len(last[1]) + len(other) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def _having(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``keyed`` whose key may be wanted: probed against a bitmap of hashed keys, whose size is bounded
    whatever their number, so that texts nobody wants are spared a shuffle."""
    bits, count = 1 << 12, wanted.count()
    while bits < min(MOST_FILTER_BITS, 32 * count):
        bits *= 2
    word, mask = F.shiftright(F.pmod("key", F.lit(bits)), 5), F.expr(f"shiftleft(1L, cast(pmod(key, {bits}) & 31 as int))")
    bitmap = wanted.groupBy(word.alias("__word")).agg(F.bit_or(mask).alias("__bits"))
    return keyed.withColumn("__word", word).join(F.broadcast(bitmap), "__word").where(F.col("__bits").bitwiseAND(mask) != 0).drop("__word", "__bits")


def _blocks(rows: DataFrame, weight: Column) -> DataFrame:
    """(group, low, high, block, class, root): ``rows`` (group, class, root) of groups with several roots, once for each
    pair of blocks that they are in. A group is cut into blocks by hash; members of its most common root are in blocks of
    their own, which meet the others' only."""
    by_root = rows.groupBy("group", "root").agg(F.sum(weight).alias("__n"))
    shape = by_root.groupBy("group").agg(F.max(F.struct("__n", "root")).alias("__top"), F.sum("__n").alias("__all"), F.count("*").alias("__roots")).where("__roots > 1")
    in_blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    shape = materialise(shape.select("group", F.col("__top.root").alias("__major"), F.col("__all"), in_blocks(F.col("__top.__n")).alias("__majors"), in_blocks(F.col("__all") - F.col("__top.__n")).alias("__minors")), "ngram-shape")
    open_ones = rows.join(shape, "group")
    zero = F.lit(0)
    whole = open_ones.where(F.col("__all") <= BLOCK).select("group", zero.alias("low"), zero.alias("high"), zero.alias("block"), "class", "root")
    hashed, is_major = F.xxhash64("class", F.lit(11)), F.col("root") == F.col("__major")
    block = F.when(is_major, F.col("__minors") + F.pmod(hashed, "__majors").cast("int")).otherwise(F.pmod(hashed, "__minors").cast("int"))
    meets = F.sequence(zero, F.when(is_major, F.col("__minors")).otherwise(F.col("__minors") + F.col("__majors")) - 1)
    placed = open_ones.where(F.col("__all") > BLOCK).withColumn("block", block).withColumn("__other", F.explode(meets))
    return whole.unionByName(placed.select("group", F.least("block", "__other").alias("low"), F.greatest("block", "__other").alias("high"), "block", "class", "root"))


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("group", "low", "high").sortWithinPartitions("group", "low", "high")


def classes(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (doc_id, key, class, size) with a row per document; links (a, b), enough of the links
    between different sets to connect whatever is connected."""
    require(docs, "doc_id", "text")
    spark = docs.sparkSession
    buckets = buckets_for(spark, docs)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    schema = "kind int, bucket int, ids binary, counts binary, values binary, frequent binary, doc_ids array<bigint>, keys binary"
    sent = keyed.mapInArrow(trimmed(_emit(n, buckets, num, den)), schema)
    found = materialise(sent.groupBy("bucket").applyInArrow(_meet, "kind int, a long, b long, c long, d long"), "ngram-found", ["kind"])
    members = found.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("key"), F.col("c").alias("class"), F.col("d").alias("size"))
    groups = materialise(found.where("kind = 1").select(F.col("a").alias("group"), F.col("b").alias("class")).distinct(), "ngram-groups")

    # One text for each class that has candidates.
    wanted = groups.select("class").distinct().join(members.groupBy("class").agg(F.min("key").alias("key")), "class")
    wanted = materialise(wanted, "ngram-wanted")
    own_key = wanted.select("key", "class")
    sketched = _having(keyed, wanted).select(F.col("key").alias("class"), "text").mapInArrow(trimmed(_sketched(n)), "class long, size long, sketch binary")
    one_each = sketched.groupBy(F.col("class").alias("key")).agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    sketches = materialise(one_each.join(own_key, "key").select("class", "size", "sketch"), "ngram-sketches")
    one = lambda side, df, *columns: df.select(F.col("class").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])

    def texts_of(asked: DataFrame) -> DataFrame:
        asked = materialise(asked.join(own_key, "class"), "ngram-asked")
        return _having(keyed, asked).groupBy("key").agg(F.min("text").alias("text")).join(asked, "key").select("class", "text")

    # 1. Every class with the least member that it met.
    heads = groups.groupBy("group").agg(F.min("class").alias("a"))
    first = groups.join(heads, "group").where("class <> a").groupBy(F.col("class").alias("b")).agg(F.min("a").alias("a"))
    pairs = first.join(one("a", sketches, "size", "sketch"), "a").join(one("b", sketches, "size", "sketch"), "b").where(f"{den} * least(size_a, size_b) >= {num} * greatest(size_a, size_b)")
    near = materialise(pairs.select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(trimmed(_near(num, den)), "a long, b long"), "ngram-near")
    texts = materialise(texts_of(near.select(F.explode(F.array("a", "b")).alias("class")).distinct()), "ngram-texts")
    both = near.join(one("b", texts, "text"), "b").join(one("a", texts, "text"), "a").select("a", "b", "text_a", "text_b")
    links = materialise(both.mapInArrow(trimmed(_compare(n, num, den)), "a long, b long"), "ngram-links")
    discard(near, texts)

    # 2. Regions of classes in different clusters that may link.
    roots = components(links).select(F.col("node").alias("class"), "root")
    roots = F.broadcast(roots) if roots.count() <= BROADCAST_IDS else roots
    labelled = groups.join(roots, "class", "left").select("group", "class", F.coalesce("root", "class").alias("root"))
    rows = _blocks(labelled, F.lit(1)).join(sketches, "class").select("group", "low", "high", "block", "class", "root", "size", "sketch")
    edges = materialise(_dealt(rows).mapInArrow(trimmed(_regions(num, den)), "a long, b long"), "ngram-edges")
    sizes = sketches.select("class", "size")
    regions = components(edges).select(F.col("node").alias("class"), F.col("root").alias("group"))
    regions = materialise(regions.join(roots, "class", "left").join(sizes, "class").select("group", "class", F.coalesce("root", "class").alias("root"), "size"), "ngram-regions")
    discard(groups, sketches, edges)

    # 3. The links between clusters of a region.
    grams = texts_of(regions.select("class")).mapInArrow(trimmed(_grams(n)), "class long, grams binary")
    rows = _blocks(regions, F.ceil(F.col("size") / SHARE)).join(materialise(grams, "ngram-grams"), "class").select("group", "low", "high", "block", "class", "root", "grams")
    more = materialise(_dealt(rows).mapInArrow(trimmed(_within(num, den)), "a long, b long"), "ngram-more")
    return members, links.unionByName(more)


def _rooted(members: DataFrame, links: DataFrame) -> DataFrame:
    """(class, root, least, first) of every class: the least doc_id and the least (doc_id, key), nulls last."""
    roots = components(links).select(F.col("node").alias("class"), "root")
    own = members.groupBy("class").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
    return materialise(own.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class")), "ngram-rooted")


def join(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id reachable), class_id (of equal sets)."""
    members, links = classes(docs, n, num, den)
    rooted = _rooted(members, links)
    least = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "ngram-least")
    ids = materialise(rooted.join(least, "root").select("class", "component_id"), "ngram-components")
    has = F.col("size") > 0
    return members.join(ids, "class", "left").select("doc_id", F.col("size").alias("n_shingles"), F.when(has, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(has, F.col("class")).alias("class_id"))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the document with the least id stays (null ids
    last; where an id has several texts, the one with the least hash), and every document without n-grams. A row goes by
    its id and its text, so another text with the same id stays; rows equal in both stay or go together."""
    members, links = classes(docs, n, num, den)
    rooted = _rooted(members, links)
    stays = materialise(rooted.groupBy("root").agg(F.min("first").alias("__stays")), "ngram-stays")
    by_class = rooted.join(stays, "root").select("class", "__stays")
    other = members.where("size > 0").join(by_class, "class").where(~(F.col("doc_id").eqNullSafe(F.col("__stays.doc_id")) & (F.col("key") == F.col("__stays.key"))))
    gone = materialise(other.select(F.col("doc_id").alias("__gone"), F.col("key").alias("__key")).distinct(), "ngram-gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col("__gone")) & (F.xxhash64(docs["text"]) == F.col("__key")), "left_anti")
