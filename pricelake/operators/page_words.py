"""Lines and columns of whole pages: arrays of words (x0, x1, top, text) in, arrays out, for batches of pages at once. What
depends on the path (the running middle of a row) is walked; all else is sorted and counted."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pages that are worked on at once.
SLICE = 256


class Words:
    """The words of some pages in the order of their rows: ``page``, ``x0``, ``x1``, ``top``, ``texts``, and ``line``, which
    counts through all pages; ``first`` is each page's first line, with the number of all at the end."""

    def __init__(self, pages: pa.ListArray, tolerance: float):
        flat, sizes = pages.flatten(), pc.list_value_length(pages).to_numpy(zero_copy_only=False)
        page = np.repeat(np.arange(len(pages)), sizes)
        x0, x1, top = (np.asarray(flat.field(c).to_numpy(zero_copy_only=False), dtype="float64") for c in ("x0", "x1", "top"))
        order = np.lexsort((x0, np.round(top, 1), page))
        self.page, self.x0, self.x1, self.top, self.texts = page[order], x0[order], x1[order], top[order], flat.field("text").take(pa.array(order))
        begins = _row_starts(self.page, self.top, tolerance)
        self.line = np.cumsum(begins) - 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.page[begins], minlength=len(pages)))])

    @property
    def lines(self) -> int:
        return int(self.first[-1])

    def joined(self, order: np.ndarray, begins: np.ndarray, tied: np.ndarray) -> pa.Array:
        """The texts of runs of the order, joined; ``tied``: words that stand where the one before does go by their texts."""
        for a, b in _runs(tied):
            own = order[a - 1 : b]
            texts = self.texts.take(pa.array(own)).to_pylist()
            order[a - 1 : b] = own[sorted(range(len(own)), key=texts.__getitem__)]
        return pc.binary_join(pa.ListArray.from_arrays(_offsets(np.flatnonzero(begins), len(order)), self.texts.take(pa.array(order))), " ")


def _offsets(starts: np.ndarray, end: int) -> pa.Array:
    return pa.array(np.append(starts, end).astype("int32"))


def _runs(flags: np.ndarray):
    """(first, behind the last) of each run of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype("int8")))
    return zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where any differs from the one before; the first always does."""
    out = np.zeros(len(columns[0]), dtype=bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _row_starts(page: np.ndarray, top: np.ndarray, tolerance: float) -> np.ndarray:
    """Words from the top down belong to one row while they stay within the tolerance of its running middle."""
    out = np.zeros(len(top), dtype=bool)
    at = np.flatnonzero(_changes(page, top))  # runs of one height
    if not len(at):
        return out
    # Tops are in order but for what rounding hides; beyond that a row surely ends.
    tops, pages = top[at], page[at]
    sure = np.concatenate([[True], (pages[1:] != pages[:-1]) | (tops[1:] - tops[:-1] > tolerance + 0.2)])
    out[at[sure]] = True
    sizes = np.diff(np.append(at, len(top)))
    for a, b in _runs(~sure):
        middle = tops[a - 1]
        for i in range(a, b):
            if abs(tops[i] - middle) > tolerance:
                out[at[i]], middle = True, tops[i]
            else:
                for _ in range(sizes[i]):
                    middle = (middle + tops[i]) / 2
    return out


def _gap_texts(pages: pa.ListArray, tolerance: float, floor: float, factor: float) -> pa.Array:
    """Of each page an array of lines, each an array of texts, cut where a gap exceeds the floor and a multiple of the
    line's upper median gap."""
    w = Words(pages, tolerance)
    order = np.lexsort((w.x1, w.x0, w.line))
    line, x0, x1 = w.line[order], w.x0[order], w.x1[order]
    begins = _changes(line)
    gap = np.full(len(line), np.nan)
    gap[1:] = x0[1:] - x1[:-1]
    gap[begins] = np.nan
    wide_enough = np.flatnonzero(gap > 0)
    ranked = wide_enough[np.lexsort((gap[wide_enough], line[wide_enough]))]
    counts = np.bincount(line[wide_enough], minlength=w.lines)
    median = np.zeros(w.lines)
    some = counts > 0
    median[some] = gap[ranked[(np.cumsum(counts) - counts + counts // 2)[some]]]
    cells = begins | (gap > np.maximum(floor, median * factor)[line])
    tied = ~cells & np.concatenate([[False], x0[1:] == x0[:-1]])
    texts = w.joined(order, cells, tied)
    starts = np.flatnonzero(np.concatenate([begins[cells]]))
    return pa.ListArray.from_arrays(pa.array(w.first.astype("int32")), pa.ListArray.from_arrays(_offsets(starts, len(texts)), texts))


def _half_even(top: np.ndarray) -> np.ndarray:
    """Rounded to one place as decimals are, not as binary fractions."""
    out = np.round(top, 1)
    close = np.flatnonzero(np.abs(top * 10 - np.floor(top * 10) - 0.5) < 1e-6)
    for i in close:
        out[i] = float(Decimal(repr(float(top[i]))).quantize(Decimal("0.1"), ROUND_HALF_EVEN))
    return out


def _columns(pages: pa.ListArray, width: np.ndarray, data: pa.ListArray, tolerance: float, min_gap: int, least_words: int, least_bounds: int) -> pa.Array:
    """Of each page a struct: texts, an array of lines, each an array of a text per column, and labels, the text above the
    first priced line by column; null where the priced lines (``data``) show no grid."""
    n, w = len(pages), Words(pages, tolerance)
    priced = np.asarray(data.flatten().to_numpy(zero_copy_only=False), dtype=bool)[w.line]
    page = w.page[priced]
    enough = np.bincount(page, minlength=n) >= least_words
    first_top = np.full(n, np.inf)
    np.minimum.at(first_top, page, w.top[priced])
    # Empty bands: where the running right edge of all words further left ends before the next begins.
    a = np.maximum(0, np.trunc(w.x0[priced]))
    b = np.fmin(np.trunc(width[page]) + 1, np.trunc(w.x1[priced]))
    order = np.lexsort((b, a, page))
    a, b, page = a[order], b[order], page[order]
    low = b.min() if len(b) else 0.0
    span = (b.max() - low if len(b) else 0.0) + 1
    edge = np.maximum.accumulate(page * span + (b - low)) - page * span + low
    before = np.concatenate([[np.inf], edge[:-1]])
    before[_changes(page)] = np.inf
    empty = a - before - 1 >= min_gap
    mids, of = (before[empty] + 1 + a[empty]) / 2, page[empty]
    inner = np.bincount(of, minlength=n)
    good = enough & (inner + 2 >= least_bounds)
    columns = np.where(good, inner + 1, 0)
    # The place of a word's middle among the bounds of its page.
    rank = np.arange(len(of)) - (np.cumsum(inner) - inner)[of]
    sorted_mids = np.full((n, int(inner.max()) if len(of) else 0), np.inf)
    mids = mids[np.lexsort((mids, of))]
    sorted_mids[of, rank] = mids
    kept = np.flatnonzero(good[w.page])
    page, center = w.page[kept], (w.x0[kept] + w.x1[kept]) / 2
    col = np.where(center >= 0, 0, columns[page] - 1)
    for j in range(sorted_mids.shape[1]):
        col += (center >= 0) & (sorted_mids[page, j] <= center)
    col = np.where(col < columns[page], col, columns[page] - 1)
    # Texts by line and column.
    line_top = _half_even(w.top[kept])
    order = np.lexsort((w.x0[kept], line_top, col, w.line[kept]))
    o, c, t = kept[order], col[order], line_top[order]
    cells = _changes(w.line[o], c)
    tied = ~cells & ~_changes(t, w.x0[o])
    texts = w.joined(o.copy(), cells, tied)
    widths = columns[np.repeat(np.arange(n), np.diff(w.first))]
    starts = np.concatenate([[0], np.cumsum(widths)])
    source = np.full(int(starts[-1]), -1)
    source[starts[w.line[o[cells]]] + c[cells]] = np.arange(len(texts))
    whole = pc.fill_null(texts.take(pa.array(source, mask=source < 0)), "")
    lines = pa.ListArray.from_arrays(pa.array(w.first.astype("int32")), pa.ListArray.from_arrays(pa.array(starts.astype("int32")), whole))
    # What stands above the first priced line.
    above = w.top[kept] < first_top[page]
    k, c = kept[above], col[above]
    order = np.lexsort((w.x0[k], w.top[k], c, w.page[k]))
    o, c = k[order], c[order]
    cells = _changes(w.page[o], c)
    labels = w.joined(o.copy(), cells, ~cells & ~_changes(w.top[o], w.x0[o]))
    starts = np.concatenate([[0], np.cumsum(columns)])
    source = np.full(int(starts[-1]), -1)
    source[starts[w.page[o[cells]]] + c[cells]] = np.arange(len(labels))
    heads = pa.ListArray.from_arrays(pa.array(starts.astype("int32")), labels.take(pa.array(source, mask=source < 0)))
    return pa.StructArray.from_arrays([lines, heads], ["texts", "labels"], mask=pa.array(~good))


def _sliced(work, pages: pa.ListArray, *others: pa.Array) -> pa.Array:
    parts = [work(*[x.slice(i, SLICE) for x in (pages, *others)]) for i in range(0, len(pages), SLICE)]
    return pa.concat_arrays(parts)


def gap_texts(pages: pa.ListArray, tolerance: float, floor: float, factor: float) -> pa.Array:
    return _sliced(lambda p: _gap_texts(p, tolerance, floor, factor), pages)


def columns(pages: pa.ListArray, width: pa.Array, data: pa.ListArray, *limits) -> pa.Array:
    number = lambda x: np.asarray(x.to_numpy(zero_copy_only=False), dtype="float64")
    return _sliced(lambda p, w, d: _columns(p, number(w), d, *limits), pages, width, data)
