"""Reading: filters, lists, previews, searches and queues. All are lazy; limits apply after the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tariffs import tiers_text
from ..functions.text import ilike_any, strip


def where_given(df: DataFrame, **values) -> DataFrame:
    """Equality filters, each only if its value is truthy (an empty string filters nothing)."""
    for column, value in values.items():
        if value:
            df = df.where(F.col(column) == value)
    return df


def where_flag(df: DataFrame, column: str, value: bool | None) -> DataFrame:
    """True, false, or no filter."""
    return df if value is None else df.where(F.col(column) == value)


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int | None = None) -> DataFrame:
    """Ordered rows ``offset .. offset + limit``; the limit is capped at ``most``."""
    kept = min(limit, most) if most else limit
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(kept)


def with_partner(items: DataFrame, partners: DataFrame) -> DataFrame:
    """Adds partner_name; null for an unknown partner."""
    return items.join(partners.select("partner_id", F.col("name").alias("partner_name")), "partner_id", "left")


def price_list(items: DataFrame, partner_id, active_only: bool = True, limit: int = 500, offset: int = 0) -> DataFrame:
    own = items.where(F.col("partner_id") == partner_id)
    own = own.where("is_active") if active_only else own
    return page(own, [F.asc_nulls_last("section"), F.asc_nulls_last("name"), F.asc("seq")], limit, offset, 5000)


def merged(rows: DataFrame, order: str = "seq") -> DataFrame:
    """Rows that differ in nothing but their code become one: the first stays, with how many there were and their codes
    in order (null for a single one)."""
    money = lambda c: F.coalesce(F.bround(F.col(c), 2).cast("string"), F.lit("-"))
    key = [strip(F.col("name")), money("price_resident"), money("price_nonresident"), tiers_text(F.col("tiers")), F.col("currency")]
    keyed = rows.select("*", *[k.alias(f"__k{i}") for i, k in enumerate(key)])
    codes = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.coalesce("code", F.lit("")) != "", F.struct(order, "code")))), lambda s: s["code"]))
    grouped = keyed.groupBy(*[f"__k{i}" for i in range(len(key))]).agg(F.min_by(F.struct(*rows.columns), order).alias("__row"), F.count("*").alias("merged_count"), codes.alias("__codes"))
    return grouped.select("__row.*", "merged_count", F.when((F.col("merged_count") > 1) & (F.size("__codes") > 0), F.col("__codes")).alias("merged_codes"))


def offers(items: DataFrame, partners: DataFrame, service_ids: DataFrame) -> DataFrame:
    """Who offers a service, cheapest first, unpriced last."""
    own = items.where("is_active").join(service_ids, "service_id", "left_semi")
    return own.join(partners.select("partner_id", F.col("name").alias("partner_name"), "city"), "partner_id").orderBy("service_id", F.asc_nulls_last("price_resident"), "seq")


def search_items(items: DataFrame, raw: str, key: str) -> DataFrame:
    """Active items whose raw name holds the query, or whose normalised name holds its key."""
    return items.where(F.col("is_active") & (ilike_any(F.col("name"), raw) | ilike_any(F.col("name_norm"), key)))


def unmatched(items: DataFrame) -> DataFrame:
    return items.where("is_active and service_id is null")


def review(items: DataFrame) -> DataFrame:
    """To be reviewed and not verified, active or not."""
    return items.where("needs_review and not is_verified")


def flagged(items: DataFrame) -> DataFrame:
    """Active, not verified, and with a flag of the cleaner in its reason."""
    return items.where(F.col("is_active") & ~F.col("is_verified") & F.col("review_reason").like("%LLM:%"))


def best_offers(items: DataFrame) -> DataFrame:
    """Adds the least resident price per name (any case) and whether a row has it."""
    least = F.min("price_resident").over(Window.partitionBy(F.lower("name")))
    return items.withColumn("best_price", least).withColumn("is_best", F.coalesce(F.col("price_resident") == F.col("best_price"), F.lit(False)))


def runs(rows: DataFrame, by: list[str], order: list[str], column: str) -> DataFrame:
    """Numbers the runs of equal values: neighbours with the same value share a number."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = (~F.col(column).eqNullSafe(F.lag(column).over(w)) | F.lag(F.lit(1)).over(w).isNull()).cast("int")
    return rows.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def locale_order(column: str, descending: bool = False, locale: str = "RU") -> list[Column]:
    """By the locale's rules, empty and null last in both directions."""
    c = F.col(column)
    empty = F.coalesce(c, F.lit("")) == ""
    return [empty.asc(), F.collate(c, locale).desc() if descending else F.collate(c, locale).asc()]
