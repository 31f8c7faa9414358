"""Row validation and audits of the store."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import reasons_text
from ..schema import ANOMALY_SHARE, CURRENCIES, FORMATS, IMPLAUSIBLE_PRICE, MATCH_AUTO, STATUSES

# Words of a header row, and names that stand for none.
HEADER_MARKERS = ("наименование", "цена для", "цена с учетом", "единица измер", "прейскурант")
NO_NAMES = ("", "(?)", "-", "—")


def droppable_name(name: Column) -> Column:
    return F.coalesce(F.regexp_replace(name, r"(?U)^\s+|\s+$", "").isin(*NO_NAMES), F.lit(True))


def header_row(name: Column) -> Column:
    return F.lower(F.coalesce(name, F.lit(""))).rlike("|".join(HEADER_MARKERS))


def reasons(as_of: date, resident: str = "price_resident", nonresident: str = "price_nonresident", day: str = "effective_date", previous: str = "prev_resident", share: float = ANOMALY_SHARE) -> Column:
    """An array of review reasons in their order, nulls for those that don't hold."""
    r, n, p = F.col(resident), F.col(nonresident), F.nullif(F.col(previous), F.lit(0))
    change = F.abs(F.nullif(r, F.lit(0)) - p) / p
    return F.array(
        F.when(r.isNull() | (r <= 0), "price missing or not positive").when(r > IMPLAUSIBLE_PRICE, "implausibly large price (suspected OCR error)"),
        F.when(n < r, "nonresident price lower than resident"),
        F.when(F.col(day) > F.lit(as_of), "effective date is in the future"),
        F.when((p > 0) & (change > share), F.format_string("price changed %d%% vs previous version", F.bround(change * 100, 0).cast("long"))),
    )


def validated(items: DataFrame, as_of: date, extra: Column | None = None, **columns) -> DataFrame:
    """Adds review_reason and needs_review. ``extra``: an array of further reasons, which follow."""
    found = reasons(as_of, **columns)
    found = F.array_compact(F.concat(found, extra) if extra is not None else found)
    return items.withColumn("review_reason", reasons_text(found)).withColumn("needs_review", F.size(found) > 0)


def audit(items: DataFrame, as_of: date) -> DataFrame:
    """One row per rule of the item table: how many rows break it (one pass over the table)."""
    r, n = F.col("price_resident"), F.col("price_nonresident")
    rules = {
        "future_date": F.col("effective_date") > F.lit(as_of),
        "empty_name": F.coalesce(F.trim("name"), F.lit("")) == "",
        "null_key": F.col("name_norm").isNull(),
        "unknown_currency": ~F.col("currency").isin(*CURRENCIES),
        "implausible_price": r > IMPLAUSIBLE_PRICE,
        "unpriced_not_reviewed": (r.isNull() | (r <= 0)) & ~F.col("needs_review"),
        "nonresident_lower_not_reviewed": (n < r) & ~F.col("needs_review"),
        "review_without_reason": F.col("needs_review") & (F.coalesce("review_reason", F.lit("")) == ""),
        "matched_without_method": F.col("service_id").isNotNull() & F.col("match_method").isNull(),
        "low_confidence_match": F.col("service_id").isNotNull() & (F.col("match_method") != "manual") & (F.coalesce("match_confidence", F.lit(0.0)) < MATCH_AUTO),
        "confidence_out_of_range": (F.col("match_confidence") < 0) | (F.col("match_confidence") > 1),
    }
    counts = items.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    return counts.select(F.explode(F.create_map(*[x for name in rules for x in (F.lit(name), F.col(name))])).alias("rule", "broken"))


def audit_documents(documents: DataFrame, items: DataFrame, as_of: date) -> DataFrame:
    """The same for documents."""
    empty = documents.join(items.select("doc_id").distinct(), "doc_id", "left_anti")
    counts = documents.agg(
        F.count_if(~F.col("parse_status").isin(*STATUSES)).alias("unknown_status"),
        F.count_if(~F.col("file_format").isin(*FORMATS)).alias("unknown_format"),
        F.count_if(F.col("parsed_at").isNull()).alias("never_parsed"),
        F.count_if(F.col("effective_date") > F.lit(as_of)).alias("future_date"),
    ).crossJoin(empty.agg(F.count_if(F.col("parse_status") != "error").alias("empty_not_error")))
    return counts.select(F.explode(F.create_map(*[x for name in counts.columns for x in (F.lit(name), F.col(name))])).alias("rule", "broken"))


def converted_wrongly(items: DataFrame, rates: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Foreign prices whose stored value isn't original times rate."""
    joined = items.where("currency <> 'KZT'").join(rates.select(F.col("code").alias("currency"), "per_unit"), "currency")
    return joined.where(F.abs(F.round(F.col("price_original") * F.col("per_unit"), 2) - F.col("price_resident")) > tolerance)


def orphans(items: DataFrame, services: DataFrame) -> DataFrame:
    """Items that point to a service that isn't there."""
    return items.where("service_id is not null").join(services.select("service_id"), "service_id", "left_anti")


def duplicate_active(items: DataFrame, by: list[str]) -> DataFrame:
    return items.where("is_active").groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")


def missing(required: DataFrame, present: DataFrame, column: str) -> DataFrame:
    return required.select(column).distinct().join(present.select(column), column, "left_anti")


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]
