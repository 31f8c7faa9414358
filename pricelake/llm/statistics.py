"""Statistics of a document's surface: what the quality operators look at. Words are runs of ``[^\\x20\\x09-\\x0D]``."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_SYMBOLS = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)
_SPACES = np.frombuffer(b" \t\n\r\x0b\x0c", dtype=np.uint8)
_STOPS = np.frombuffer(b".,;:", dtype=np.uint8)


@dataclass(slots=True)
class Surface:
    n_words: int = 0
    word_chars: int = 0
    n_symbols: int = 0
    n_dup_lines: int = 0
    n_repeat_words: int = 0
    n_lines: int = 0
    n_upper: int = 0
    n_lower: int = 0
    n_digits: int = 0
    n_marks: int = 0
    n_stops: int = 0
    n_same_next: int = 0
    n_distinct: int = 0

    def per_word(self, n: int) -> float:
        return n / self.n_words if self.n_words else 0.0


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found at least twice."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    inside = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.fromiter((i for i, w in enumerate(windows) if counts[w] > 1), dtype=np.int64)
    np.add.at(inside, at, 1)
    np.add.at(inside, np.minimum(at + 3, len(words)), -1)
    return int((np.cumsum(inside)[:-1] > 0).sum())


def surface(text: bytes | None) -> Surface:
    if not text:
        return Surface()
    h = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    return Surface(
        n_words=len(words),
        word_chars=int(len(text) - h[128:192].sum() - h[_SPACES].sum()),
        n_symbols=int(h[_SYMBOLS].sum()),
        n_dup_lines=len(lines) - len(set(lines)),
        n_repeat_words=repeated_words(words),
        n_lines=len(lines),
        n_upper=int(h[65:91].sum()),
        n_lower=int(h[97:123].sum()),
        n_digits=int(h[48:58].sum()),
        n_marks=int(h[33] + h[63]),
        n_stops=int(h[_STOPS].sum()),
        n_same_next=sum(map(bytes.__eq__, words, words[1:])),
        n_distinct=len(set(words)),
    )


def surfaces(column) -> Iterator[Surface]:
    """Of an Arrow text column."""
    import pyarrow as pa

    return map(surface, column.cast(pa.binary()).to_pylist())
