"""Golden price lists: JSON files with expected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "source_file string, partner string, extracted_by string, sampled boolean, note string, rows array<struct<name: string, code: string, unit: string, section: string, price_resident_kzt: double, "
    "price_nonresident_kzt: double, price_extra_tiers: map<string, double>, currency_original: string, expect_review: boolean, note: string>>"
)


def rows(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, partner, place, name, code, ..., currency): the currency is KZT where none is given."""
    files = spark.read.json(path, schema=SCHEMA, multiLine=True)
    out = files.select("source_file", "partner", F.posexplode("rows").alias("place", "r")).select("source_file", "partner", "place", "r.*")
    return out.withColumn("currency_original", F.coalesce("currency_original", F.lit("KZT"))).withColumn("expect_review", F.coalesce("expect_review", F.lit(False)))
