"""Numbers out of damaged cells: ``Column -> Column``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Glyphs that stand for digits in scanned numbers, and the digits.
LOOKALIKE_GLYPHS = "ОоOoQΟο□СсCcIl|іӀ¡ΙЗзбBВgqSsЅ"
LOOKALIKE_DIGITS = "00000000000011111113368899555"
# Currency words, and the spaces that group thousands.
CURRENCY_WORDS = r"(?iu)(тенге|тнг|тг|₸|kzt|руб(?:лей|ля|\.)?|rub|₽|usd|\$|долл(?:ар)?)\.?"
UNIT_WORDS = r"(?iu)(тенге|тнг|тг|₸|kzt|руб|rub)\.?"
_GROUPING = "    \t"


def detect_currency(text: Column) -> Column:
    """USD before RUB, else KZT."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.rlike(r"\$|usd|долл"), "USD").when(low.rlike("руб|₽|rub"), "RUB").otherwise("KZT")


def _parsed(bare: Column, aggressive: bool) -> Column:
    """struct(value, kept) of a text without currency words; every step is computed once."""

    def split(kept):
        return let(F.regexp_extract(kept, r"[.,](\d{1,2})$", 1), lambda fraction: joined(kept, fraction))

    def joined(kept, fraction):
        main = F.when(fraction != "", F.substring(kept, F.lit(1), F.length(kept) - F.length(fraction) - 1)).otherwise(kept)
        return let(F.translate(main, ".,", ""), lambda whole: F.struct(F.when(whole != "", F.concat_ws(".", whole, F.nullif(fraction, F.lit(""))).try_cast("double")).alias("value"), kept.alias("kept")))

    read = F.translate(bare, LOOKALIKE_GLYPHS, LOOKALIKE_DIGITS) if aggressive else bare
    return let(F.regexp_replace(read, "[^0-9.,]", ""), split)


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, CURRENCY_WORDS, " ")


def parse_price(text: Column, aggressive: bool = False) -> Column:
    """struct(value, clean). A last ``,d`` or ``.dd`` is the fraction, other separators go; ``aggressive`` reads glyphs
    that look like digits as digits. ``clean`` is false where anything but digits and separators was there."""

    def judged(bare):
        return let(_parsed(bare, aggressive), lambda found: let(text.isNull() | ~text.rlike(r"(?U)\S"), lambda blank: result(bare, found, blank)))

    def result(bare, found, blank):
        clean = F.when(blank, True).when(found["kept"] == "", False).otherwise(found["value"].isNotNull() & ~bare.rlike(f"[^0-9.,{_GROUPING}]"))
        return F.struct(F.when(~blank, found["value"]).alias("value"), clean.alias("clean"))

    return let(_bare(text), judged)


#: Any character that neither a number, nor a glyph like a digit, nor a currency word holds: most names have one early.
_FOREIGN = r"(?iuU)[^\s0-9.," + LOOKALIKE_GLYPHS.replace("|", r"\|") + "".join(sorted(set("тенгетнгтгkztрублейляrubusdдоллар"))) + "₸₽$]"


def price_cell_value(text: Column) -> Column:
    """The value of a cell made of digits, separators and look-alikes only, if it is positive."""
    glyphs = LOOKALIKE_GLYPHS.replace("|", r"\|")
    of_digits = lambda bare: bare.rlike(r"(?U)\S") & ~bare.rlike(rf"(?U)[^\s0-9.,{glyphs}]")
    value = let(_bare(text), lambda bare: F.when(of_digits(bare), let(_parsed(bare, True)["value"], lambda value: F.when(value > 0, value))))
    plain = text.try_cast("double")  # most prices are
    return F.when(text.rlike(r"^[0-9]{1,12}(?:\.[0-9]{1,2})?\z"), F.when(plain > 0, plain)).when(~text.rlike(_FOREIGN), value)


def is_number_cell(text: Column) -> Column:
    """Digits and separators only, after units went; at least one digit."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), UNIT_WORDS, ""), r"(?U)^\s+|\s+$", "")
    return bare.rlike(r"(?U)^[\d.,\s]+$") & bare.rlike(r"\d")


def whole_number(text: Column) -> Column:
    """An integer out of a string of digits, else null."""
    return F.regexp_replace(text, r"(?U)\s", "").try_cast("bigint")


def near(a: Column, b: Column, tolerance: float = 0.5) -> Column:
    """Within the tolerance; two nulls are near, one null is not."""
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(F.abs(a - b) <= tolerance)
