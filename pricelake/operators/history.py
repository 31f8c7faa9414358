"""Price history: points per date, changes between them, and their ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def related(items: DataFrame, code: str | None, name_norm: str | None, name: str | None, partner_id, include_inactive: bool = False) -> DataFrame:
    """One item's history rows: same partner and (same code or same name); by raw name if it has neither. Active rows
    only, unless asked."""
    match = F.lit(False)
    if code:
        match = match | (F.col("code") == code)
    if name_norm:
        match = match | (F.col("name_norm") == name_norm)
    if not code and not name_norm:
        match = F.col("name") == name
    found = items.where((F.col("partner_id") == partner_id) & match & F.col("effective_date").isNotNull())
    return found if include_inactive else found.where("is_active")


def related_pairs(items: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed_id, item_id) for many seeds: a union of two equi-joins instead of a join on an OR."""
    own = items.select(F.col("item_id"), "partner_id", "code", "name_norm")
    asked = seeds.select(F.col("item_id").alias("seed_id"), "partner_id", "code", "name_norm")
    by_code = asked.drop("name_norm").join(own.drop("name_norm"), ["partner_id", "code"])
    by_name = asked.drop("code").join(own.drop("code"), ["partner_id", "name_norm"])
    return by_code.select("seed_id", "item_id").union(by_name.select("seed_id", "item_id")).distinct()


def related_counts(items: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed_id, related) for many seeds: how many items share the partner and the code or the name, by counts of both less
    the counts of those that share all, so that no pair is written. Seeds without any are left out."""
    out = seeds.select(F.col("item_id").alias("seed_id"), "partner_id", "code", "name_norm")
    keys = {"__code": ["partner_id", "code"], "__name": ["partner_id", "name_norm"], "__both": ["partner_id", "code", "name_norm"]}
    for n, by in keys.items():
        out = out.join(items.dropna(subset=by).groupBy(*by).agg(F.count("*").alias(n)), by, "left")
    none = F.lit(0)
    related = F.coalesce("__code", none) + F.coalesce("__name", none) - F.coalesce("__both", none)
    return out.select("seed_id", related.alias("related")).where("related > 0")


def points(items: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row per date: the first with a resident price, else the first."""
    first = Window.partitionBy(*by, "effective_date").orderBy(F.col("price_resident").isNull(), *order)
    return items.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth")


def changes(points: DataFrame, by: list[str]) -> DataFrame:
    """``change_pct`` against the point just before, null if its price is null or zero."""
    before = F.lag("price_resident").over(Window.partitionBy(*by).orderBy("effective_date"))
    return points.withColumn("__before", F.nullif(before, F.lit(0))).withColumn("change_pct", (F.col("price_resident") - F.col("__before")) / F.col("__before") * 100).drop("__before")


def overall(points: DataFrame, by: list[str]) -> DataFrame:
    """First and last priced point, the change between them, years seen, points."""
    priced = F.col("price_resident").isNotNull()
    day = F.when(priced, F.col("effective_date"))
    first, last = F.min_by("price_resident", day), F.max_by("price_resident", day)
    return points.groupBy(*by).agg(
        first.alias("first_price"),
        last.alias("last_price"),
        ((last - first) / F.nullif(first, F.lit(0)) * 100).alias("total_change_pct"),
        F.countDistinct(F.year("effective_date")).alias("years"),
        F.count("*").alias("points"),
    )


def year(c: Column) -> Column:
    return F.year(c)
