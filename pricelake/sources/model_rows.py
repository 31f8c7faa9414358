"""Rows out of what a language model answered: JSON in prose, tiers under free labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import parse_price
from ..functions.tariffs import canonical_tier
from ..functions.text import blank_to_null, strip

_ROW = "struct<name: string, code: string, unit: string, section: string, currency: string, price_resident_kzt: string, price_nonresident_kzt: string, extra_tiers: array<struct<label: string, price_kzt: string>>>"


def answer_json(answer: Column) -> Column:
    """What follows the last thought, from the first brace to the last, unless it is a list by itself."""
    said = F.regexp_replace(answer, r"(?s)^.*</think>", "")
    braced = F.regexp_extract(said, r"(?s)(\{.*\})", 1)
    return F.when(strip(said).rlike(r"(?s)^\[.*\]$"), strip(said)).otherwise(blank_to_null(braced))


def _number(text: Column) -> Column:
    """Booleans are no numbers; plain numbers are read as they are, others aggressively."""
    return F.when(F.lower(text).isin("true", "false"), None).otherwise(F.coalesce(text.try_cast("double"), parse_price(text, aggressive=True)["value"]))


def rows(answers: DataFrame) -> DataFrame:
    """answers: ``doc_id, answer``. One row per named row: tiers that are the resident's or nonresident's by their label
    fill an empty slot, others stay extra, a later one of the same label replacing the earlier."""
    text = answer_json(F.col("answer"))
    listed = F.coalesce(F.get_json_object(text, "$.rows"), text)
    items = answers.select("doc_id", F.posexplode(F.from_json(listed, f"array<{_ROW}>")).alias("place", "r"))
    named = items.where(F.coalesce(strip(F.col("r.name")), F.lit("")) != "")
    tiers = F.filter(F.transform(F.coalesce("r.extra_tiers", F.array().cast("array<struct<label:string,price_kzt:string>>")), lambda t: F.struct(canonical_tier(t["label"]).alias("label"), _number(t["price_kzt"]).alias("p"))), lambda t: t["p"].isNotNull() & (t["label"] != ""))
    of = lambda label: F.get(F.transform(F.filter(tiers, lambda t: t["label"] == label), lambda t: t["p"]), F.lit(0))
    resident, nonresident = _number(F.col("r.price_resident_kzt")), _number(F.col("r.price_nonresident_kzt"))

    def stays(t, i):
        same = F.filter(F.transform(tiers, lambda x, j: F.struct(x["label"].alias("label"), j.alias("j"))), lambda x: x["label"] == t["label"])
        filled = ((t["label"] == "резидент") & resident.isNull()) | ((t["label"] == "нерезидент") & nonresident.isNull())
        return (i == F.element_at(same, -1)["j"]) & ~(filled & (i == F.element_at(same, 1)["j"]))

    extra = F.map_from_entries(F.transform(F.filter(tiers, stays), lambda t: F.struct(t["label"].alias("key"), t["p"].alias("value"))))
    field = lambda n: blank_to_null(strip(F.col(f"r.{n}")))
    return named.select(
        "doc_id",
        "place",
        strip(F.col("r.name")).alias("name"),
        field("code").alias("code"),
        field("unit").alias("unit"),
        field("section").alias("section"),
        F.coalesce(F.upper(field("currency")), F.lit("KZT")).alias("currency"),
        F.coalesce(resident, of("резидент")).alias("resident"),
        F.coalesce(nonresident, of("нерезидент")).alias("nonresident"),
        F.when(F.size(extra) > 0, extra).alias("extra_tiers"),
        F.lit(True).alias("tariffs_resolved"),
    )
