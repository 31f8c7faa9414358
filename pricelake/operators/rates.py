"""Exchange rates on prices: dated, last known, static."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tariffs import to_kzt
from ..schema import LAST_GOOD_RATES, STATIC_RATES


def literal_rates(spark, rates: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(rates.items()), "code string, text string").select("code", F.col("text").cast("decimal(12,6)").alias("per_unit"))


def with_fallback(spark, dated: DataFrame, wanted: DataFrame) -> DataFrame:
    """(as_of, code, per_unit, source) for the wanted (as_of, code): the feed of that day, else the last good rate, else
    the static one."""
    good = literal_rates(spark, LAST_GOOD_RATES).withColumnRenamed("per_unit", "good")
    static = literal_rates(spark, STATIC_RATES).withColumnRenamed("per_unit", "static")
    found = wanted.join(dated.select("as_of", "code", F.col("per_unit").alias("dated")), ["as_of", "code"], "left").join(F.broadcast(good), "code", "left").join(F.broadcast(static), "code", "left")
    source = F.when(F.col("dated").isNotNull(), "nbk").when(F.col("good").isNotNull(), "last_good").when(F.col("static").isNotNull(), "fallback")
    return found.select("as_of", "code", F.coalesce("dated", "good", "static").alias("per_unit"), source.alias("source"))


def convert(items: DataFrame, rates: DataFrame, columns: list[str], currency: str = "currency") -> DataFrame:
    """Price columns in tenge by (code, per_unit) rates; an unknown currency counts 1."""
    joined = items.join(F.broadcast(rates.select(F.col("code").alias(currency), F.col("per_unit").alias("__rate"))), currency, "left")
    for c in columns:
        joined = joined.withColumn(c, to_kzt(F.col(c), F.col(currency), F.col("__rate")))
    return joined.drop("__rate")


def as_of(items: DataFrame, rates: DataFrame, day: str = "effective_date", currency: str = "currency") -> DataFrame:
    """Adds the latest ``per_unit`` at or before each row's day. Rates turn into ranges of days (one window over the small
    side), which meet items by an equi-join on currency and a range."""
    until = F.lead("as_of").over(Window.partitionBy("code").orderBy("as_of"))
    ranges = rates.withColumn("__until", until).select(F.col("code").alias("__code"), F.col("as_of").alias("__from"), "__until", "per_unit")
    inside = (F.col(currency) == F.col("__code")) & (F.col(day) >= F.col("__from")) & (F.col("__until").isNull() | (F.col(day) < F.col("__until")))
    return items.join(F.broadcast(ranges) if ranges.count() <= 100_000 else ranges, inside, "left").drop("__code", "__from", "__until")


def display_rate(c: Column) -> Column:
    return F.bround(c, 4)
