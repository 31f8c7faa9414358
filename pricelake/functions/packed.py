"""Whole numbers side by side in longs, so that an exchange moves the bits that its rows need: ``Column -> Column``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b: int) -> Column:
    """Whole division of longs."""
    return F.call_function("div", a, F.lit(b).cast("long"))


def cents(value: Column, money: str) -> Column:
    """Hundredths of a double as a cast to the decimal rounds it. One that is the nearest to whole hundredths prints as
    those, so that it needn't be printed."""
    near = F.floor(value * 100 + 0.5)
    return F.when(near / F.lit(100.0) == value, near).otherwise((value.cast(money) * 100).cast("long"))


def text_order(n: Column, most: int) -> Column:
    """Orders numbers from 0 to ``most`` as their texts, each followed by a sign that is less than digits."""
    places = len(str(most))
    by_length = [(n * 10 ** (places - k) * 32 + k, 10**k) for k in range(1, places + 1)]
    out = by_length[-1][0]
    for key, beyond in reversed(by_length[:-1]):
        out = F.when(n < beyond, key).otherwise(out)
    return out


class Packed:
    """Fields between known bounds, in longs that they fill one after the other, the first in the lowest bits. What
    doesn't fit, in ``words`` longs at most, is an OverflowError."""

    def __init__(self, bounds: dict[str, tuple[int, int]], prefix: str, words: int = 9):
        self.places: dict[str, tuple[str, int, int, int]] = {}
        word = used = 0
        for name, (least, most) in bounds.items():
            bits = max(1, (most - least).bit_length())
            if bits > 63:
                raise OverflowError(name)
            if used + bits > 63:
                word, used = word + 1, 0
            self.places[name] = f"{prefix}{word}", used, bits, least
            used += bits
        if word >= words:
            raise OverflowError(prefix)
        self.columns = [f"{prefix}{i}" for i in range(word + 1)]

    def pack(self, values: dict[str, Column]) -> list[Column]:
        words: dict[str, Column] = {}
        for name, (word, shift, _, least) in self.places.items():
            part = F.shiftleft((values[name] - least).cast("long"), shift)
            words[word] = words[word].bitwiseOR(part) if word in words else part
        return [words[word].alias(word) for word in self.columns]

    def __getitem__(self, name: str) -> Column:
        word, shift, bits, least = self.places[name]
        return F.shiftright(F.col(word), shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long")) + F.lit(least).cast("long")

    def shift(self, name: str) -> int:
        return self.places[name][1]

    def until(self, name: str) -> Column:
        """All fields of the first long up to this one, as a number that the last of them leads."""
        word, shift, bits, _ = self.places[name]
        if word != self.columns[0]:
            raise OverflowError(name)
        return F.col(word).bitwiseAND(F.lit((1 << shift + bits) - 1).cast("long"))
