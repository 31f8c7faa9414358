"""Price tiers and currencies: ``Column -> Column``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import IMPLAUSIBLE_PRICE, MONEY
from .text import let

# What a resident's column is called.
RESIDENT_WORDS = ("резидент", "граждан республики", "постоянно прожива", "кандас", "оралман")


def is_resident_label(label: Column, strict: bool = False) -> Column:
    """A substring test, so that "нерезидент" counts too unless ``strict``."""
    low = F.lower(F.coalesce(label, F.lit("")))
    hit = low.rlike("|".join(RESIDENT_WORDS))
    return hit & ~low.contains("нерезидент") if strict else hit


def map_tariffs(prices: Column, labels: Column, strict: bool = False) -> Column:
    """struct(resident, nonresident, extra): the resident's price (by label, else the first), the next one to the right
    (else the nearest to the left), and all others by label or ``tier_n``. Labels count only if there are as many as
    prices."""
    hits = F.transform(labels, lambda x: is_resident_label(x, strict))
    labelled = F.coalesce((F.size(labels) > 0) & (F.size(labels) == F.size(prices)), F.lit(False))
    found = F.coalesce(F.array_position(hits, True), F.lit(0)).cast("int")
    nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))

    def placed(x):
        resident = F.when(x["labelled"] & (x["found"] > 0), x["found"] - 1).otherwise(F.lit(0))  # from 0
        return let(resident, lambda r: let(F.when(r + 1 < F.size(prices), r + 1).otherwise(r - 1), lambda second: mapped(x["labelled"], r, second)))

    def mapped(labelled, resident, second):
        named = lambda i: F.when(labelled, F.nullif(F.regexp_replace(F.get(labels, i), r"(?U)^\s+|\s+$", ""), F.lit("")))
        blank = lambda i: F.when(labelled & (F.coalesce(F.get(labels, i), F.lit("")) != ""), F.lit(""))  # noqa: E731  a label of spaces
        entries = F.transform(prices, lambda p, i: F.struct(i.alias("i"), F.coalesce(named(i), blank(i), F.concat(F.lit("tier_"), (i + 1).cast("string"))).alias("key"), p.alias("value")))
        return let(F.filter(entries, lambda e: (e["i"] != resident) & (e["i"] != second)), lambda own: result(resident, second, own))

    def result(resident, second, entries):
        # A later price of the same label replaces an earlier one.
        last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda later: later["key"] == e["key"]))
        extra = F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))
        return F.struct(F.get(prices, resident).alias("resident"), F.when(second >= 0, F.get(prices, second)).alias("nonresident"), F.coalesce(extra, nothing).alias("extra"))

    return let(F.struct(labelled.alias("labelled"), found.alias("found")), placed)


def to_kzt(value: Column, currency: Column, rate: Column) -> Column:
    """Rounded to 2 places; tenge pass through, an unknown rate counts as 1. Decimals are exact, ties round up."""
    exact = value.cast(MONEY)
    return F.when(currency == "KZT", F.round(exact, 2)).otherwise(F.round(exact * F.coalesce(rate.cast("decimal(12,6)"), F.lit(1).cast("decimal(12,6)")), 2)).cast(MONEY)


def sane(value: Column) -> Column:
    """Null above the ceiling of plausible prices."""
    return F.when(value <= IMPLAUSIBLE_PRICE, value)


def sane_reason(value: Column, what: str) -> Column:
    return F.when(value > IMPLAUSIBLE_PRICE, F.lit(f"{what} price implausible (suspected OCR error); cleared for manual entry"))


def tiers_to_kzt(tiers: Column, currency: Column, rate: Column) -> Column:
    """Every tier in tenge; nulls and implausible ones go; null without any left."""
    converted = F.transform_values(tiers, lambda _, v: to_kzt(v, currency, rate))
    kept = F.map_filter(converted, lambda _, v: v.isNotNull() & (v <= IMPLAUSIBLE_PRICE))
    return F.when(F.size(kept) > 0, kept)


def canonical_tier(label: Column) -> Column:
    """The tier a free label stands for, by the first that fits; else its first 48 characters."""
    low = F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))
    return (
        F.when(low.contains("страхов"), "страховая")
        .when(low.rlike("нерезидент|дальн"), "нерезидент")
        .when(low.rlike("резидент|ближн"), "резидент")
        .when(low.rlike(r"(?U)\bснг\b"), "СНГ")
        .when(low.contains("партн"), "партнёр")
        .otherwise(F.substring(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""), 1, 48))
    )


def tiers_text(tiers: Column) -> Column:
    """Tiers as a sorted string: a map can't be a grouping key, and null and {} are the same."""
    entries = F.coalesce(F.array_sort(F.map_entries(tiers)), F.array().cast("array<struct<key:string,value:decimal(14,2)>>"))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
