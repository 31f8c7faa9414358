"""Counters and shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matching import percent


def overview(documents: DataFrame, partners: DataFrame, services: DataFrame, items: DataFrame) -> DataFrame:
    """One row: how many of each, how many items are matched and to be reviewed, and the match rate."""
    own = items.agg(F.count("*").alias("items"), F.count_if(F.col("service_id").isNotNull()).alias("matched"), F.count_if("needs_review").alias("needs_review"))
    out = own
    for name, df in (("documents", documents), ("partners", partners), ("services", services)):
        out = out.crossJoin(df.agg(F.count("*").alias(name)))
    return out.withColumn("match_rate", percent(F.col("matched"), F.col("items")))


def by_status(documents: DataFrame) -> DataFrame:
    return documents.groupBy("parse_status").agg(F.count("*").alias("n"))


def pie(items: DataFrame) -> DataFrame:
    """Slices: matched, to review, and what is left; empty slices go."""
    n = items.agg(F.count("*").alias("n"), F.count_if(F.col("service_id").isNotNull()).alias("matched"), F.count_if("needs_review").alias("review"))
    slices = n.selectExpr("stack(3, 'matched', matched, 'needs_review', review, 'other', greatest(0, n - matched - review)) as (slice, n)")
    return slices.where("n > 0")


def ingest_report(rows: DataFrame) -> DataFrame:
    """Per document: parsed, written, dropped, to review, matched, and its status: error without rows, needs_review with
    any, else done. rows: doc_id, dropped, needs_review, service_id."""
    written = ~F.col("dropped")
    counted = rows.groupBy("doc_id").agg(
        F.count("*").alias("parsed"),
        F.count_if(written).alias("written"),
        F.count_if("dropped").alias("dropped"),
        F.count_if(written & F.col("needs_review")).alias("review"),
        F.count_if(written & F.col("service_id").isNotNull()).alias("matched"),
    )
    return counted.withColumn("status", F.when(F.col("written") == 0, "error").when(F.col("review") > 0, "needs_review").otherwise("done"))


def job_rollup(reports: DataFrame) -> DataFrame:
    return reports.agg(F.count("*").alias("files"), F.count_if(F.col("status") == "error").alias("errors"), F.sum("written").alias("rows_written"), F.sum("review").alias("rows_needs_review"))


def list_gaps(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per list: rows, codes that repeat, sections, and pages that no row came from. rows: by, code, section, page."""
    pages = F.collect_set("page")
    counted = rows.groupBy(*by).agg(F.count("*").alias("rows"), (F.count("code") - F.countDistinct("code")).alias("duplicate_codes"), F.countDistinct("section").alias("sections"), pages.alias("__pages"))
    whole = F.sequence(F.array_min("__pages"), F.array_max("__pages"))
    return counted.withColumn("missing_pages", F.when(F.size("__pages") > 0, F.array_except(whole, "__pages"))).drop("__pages")
