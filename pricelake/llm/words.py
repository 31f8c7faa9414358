"""Words as 64-bit hashes, for the operators that look at long runs of words."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash

#: Words that a worker remembers, in two generations.
_REMEMBER = 150_000
_FACTOR = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on a fresh array."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


class WordHashes(dict):
    """Word -> 64-bit hash."""

    def __init__(self, size: int = _REMEMBER, of: Callable[[bytes], int] = xxhash.xxh3_64_intdigest):
        super().__init__()
        self.size, self.of, self.old = size, of, {}

    def __missing__(self, word: bytes) -> int:
        h = self.old.get(word)
        if h is None:
            h = self.of(word)
        if len(word) <= 64:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[word] = h
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_POWERS: dict[int, np.ndarray] = {}


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words: a polynomial in the words' hashes, mixed."""
    if len(h) < n:
        return np.empty(0, dtype=np.uint64)
    if n not in _POWERS:
        _POWERS[n] = np.array([pow(_FACTOR, n - 1 - i, 1 << 64) for i in range(n)], dtype=np.uint64)
    powers = _POWERS[n]
    total = h[: len(h) - n + 1] * powers[0]
    for i in range(1, n):
        total += h[i : len(h) - n + 1 + i] * powers[i]
    return mixed(total)
