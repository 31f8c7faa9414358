"""Dates out of text and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def feed_date(text: Column) -> Column:
    """A strict DD.MM.YYYY date, null if it isn't one of the calendar."""
    return F.when(text.rlike(r"^\d{2}\.\d{2}\.\d{4}$"), F.try_to_timestamp(text, F.lit("dd.MM.yyyy")).cast("date"))


def feed_text(d: Column) -> Column:
    return F.date_format(d, "dd.MM.yyyy")


def year_of_name(stem: Column) -> Column:
    """The greatest year 2000 .. 2100 in a name, as its first of January."""
    years = F.transform(F.regexp_extract_all(stem, F.lit(r"((?:19|20)\d{2})"), 1), lambda y: y.cast("int"))
    return F.make_date(F.array_max(F.filter(years, lambda y: (y >= 2000) & (y <= 2100))), F.lit(1), F.lit(1))
