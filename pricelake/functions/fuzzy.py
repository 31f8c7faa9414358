"""Token-set similarity, 0 to 100. The set algebra is the caller's Spark plan or this vectorised kernel; the longest
common subsequence is bit-parallel on Python integers."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence (a word of len(a) bits, one step per character of b)."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def token_set_score(x: str | None, y: str | None) -> float:
    """Common words against each side's own: 100 if one side has none of its own, else the best of the three pairings
    of (common), (common + own of x), (common + own of y) by 1 - insertions and deletions / total length."""
    a, b = set((x or "").split()), set((y or "").split())
    if not a or not b:
        return 0.0
    common, own_a, own_b = " ".join(sorted(a & b)), " ".join(sorted(a - b)), " ".join(sorted(b - a))
    if common and (not own_a or not own_b):
        return 100.0
    n, gap = len(common), 1 if common else 0
    la, lb = len(own_a), len(own_b)
    edits = la + lb - 2 * lcs_length(own_a, own_b)
    best = 100 * (1 - edits / (2 * (n + gap) + la + lb))
    if common:
        best = max(best, 100 * (1 - (gap + la) / (2 * n + gap + la)), 100 * (1 - (gap + lb) / (2 * n + gap + lb)))
    return best


def token_set_ratio(x: Column, y: Column) -> Column:
    """The score of two columns, in Arrow batches."""

    def scores(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([token_set_score(p, q) for p, q in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(scores, "double")(x, y)


class Choices:
    """Choices in order of precedence; :meth:`best` is exact without scoring all. Of the score's three pairings only
    (common + own of x), (common + own of y) needs a subsequence, which is no longer than the characters both have."""

    def __init__(self, choices: list[str | None]) -> None:
        self.choices = choices
        words = [set((c or "").split()) for c in choices]
        joined = [" ".join(w) for w in words]
        self.lengths = np.array([len(j) for j in joined], dtype=np.float64)
        self.columns = {ch: k for k, ch in enumerate(sorted(set().union(*joined)))}
        self.counts = np.zeros((len(self.columns), len(choices)), dtype=np.int32)
        places: dict[str, list[int]] = {}
        for i, j in enumerate(joined):
            for ch, n in Counter(j).items():
                self.counts[self.columns[ch], i] = n
            for w in words[i]:
                places.setdefault(w, []).append(i)
        self.places = {w: np.array(found) for w, found in places.items()}

    def best(self, key: str | None) -> tuple[int, float]:
        """(index, score) of the best choice, the first on ties."""
        words = set((key or "").split())
        if not words:
            return 0, 0.0
        joined = " ".join(words)
        common, both = np.full(len(self.choices), -1.0), np.zeros(len(self.choices))
        for w in words & self.places.keys():
            common[self.places[w]] += len(w) + 1
        for ch, n in Counter(joined).items():
            if ch in self.columns:
                both += np.minimum(self.counts[self.columns[ch]], n)
        common = np.maximum(common, 0)
        least = 200 * common / np.maximum(common + np.minimum(self.lengths, len(joined)), 1)
        most = np.maximum(least, 200 * both / (self.lengths + len(joined))) + 1e-6
        index, score = -1, -1.0
        open_ = np.flatnonzero(most >= least.max())
        for i in open_[np.argsort(-most[open_], kind="stable")]:
            if most[i] < score:
                break
            own = token_set_score(key, self.choices[i])
            if own > score or (own == score and i < index):
                index, score = int(i), own
        return index, score
