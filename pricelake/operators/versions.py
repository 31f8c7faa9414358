"""Versioned prices: which row of a partner's service is the current one, and what it replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ANOMALY_SHARE


def version_key(code: Column, name_norm: Column) -> Column:
    """Code preferred, else the normalised name, in lower case."""
    return F.lower(F.when(F.coalesce(code, F.lit("")) != "", code).otherwise(name_norm))


def fold(items: DataFrame, by: list[str], order: list[str], date: str = "effective_date", price: str = "price_resident") -> DataFrame:
    """Adds ``is_active`` and ``prev_resident``.

    In the order of ingestion, a row replaces the current one unless it is dated before it; a row without a date, and any
    row after one, always replaces. The price it replaced is given unless both have the same date. A later row of an
    earlier date is stored inactive.

    The walk is windows only: rows are cut into segments at undated rows; a row is accepted if it is undated or no
    earlier accepted row of its segment is newer, which a running maximum of all dates of the segment tells."""
    own = Window.partitionBy(*by).orderBy(*order)
    d = F.col(date)
    step = items.withColumn("__segment", F.sum(d.isNull().cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*by, "__segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    newest = F.max(d).over(inside)
    step = step.withColumn("__accepted", d.isNull() | newest.isNull() | (d >= newest))
    # Segments follow each other in the same order, so that rows needn't be sorted anew.
    own = Window.partitionBy(*by).orderBy("__segment", *order)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    previous = F.last(F.when(F.col("__accepted"), F.struct(d.alias("d"), F.col(price).alias("p"))), ignorenulls=True).over(before)
    step = step.withColumn("__prev", previous)
    later = F.max(F.col("__accepted").cast("int")).over(own.rowsBetween(1, Window.unboundedFollowing))
    same_day = F.coalesce(d == F.col("__prev.d"), F.lit(False))
    return (
        step.withColumn("is_active", F.col("__accepted") & (F.coalesce(later, F.lit(0)) == 0))
        .withColumn("prev_resident", F.when(F.col("__accepted") & ~same_day, F.col("__prev.p")))
        .drop("__segment", "__accepted", "__prev")
    )


def newest(items: DataFrame, by: list[str], order: list[str], at: str, price: str, day: int) -> DataFrame:
    """The active rows that :func:`fold` tells, with ``prev_resident``, if all rows are dated: the newest one, of the
    newest the last in the order. ``at``: a long of the row's date, from its bit ``day`` on, and its first column of order.
    One window."""
    own = Window.partitionBy(*by).orderBy(*order)
    whole, before = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), own.rowsBetween(Window.unboundedPreceding, -1)
    step = items.withColumns({"__newest": F.max(at).over(whole), "__next": F.lead(at).over(own), "__at": F.max(at).over(before), "__price": F.max_by(price, at).over(before)})
    other_day = F.shiftright("__at", day) != F.shiftright(at, day)
    step = step.where((F.col(at) == F.col("__newest")) & ~F.col(at).eqNullSafe(F.col("__next")))
    return step.withColumn("prev_resident", F.when(other_day, F.col("__price"))).drop("__newest", "__next", "__at", "__price")


def change_percent(now: Column, previous: Column) -> Column:
    """Absolute change in percent of the previous price; null where either is null or zero."""
    return F.abs(F.nullif(now, F.lit(0)) - F.nullif(previous, F.lit(0))) / F.nullif(previous, F.lit(0)) * 100


def anomalies(folded: DataFrame, share: float = ANOMALY_SHARE) -> DataFrame:
    """Rows whose price moved by more than the share of what it replaced."""
    change = change_percent(F.col("price_resident"), F.col("prev_resident"))
    return folded.withColumn("change_pct", change).where((F.col("prev_resident") > 0) & (change > share * 100))
