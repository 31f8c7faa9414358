"""Catalogue files: JSON lists or sheets, under several column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import parse_synonyms, valid_uuid

# The names a column may have.
ALIASES = {
    "service_name": ("service_name", "name", "услуга", "наименование"),
    "category": ("category", "категория"),
    "synonyms": ("synonyms", "синонимы"),
    "icd_code": ("icd_code", "icd", "мкб"),
    "service_id": ("service_id", "id"),
}


def from_table(rows: DataFrame, order: str = "seq") -> DataFrame:
    """Services out of rows whose columns have any of the names, in any case, with spaces for underscores."""
    named = {c.strip().lower().replace(" ", "_"): c for c in rows.columns}

    def first(field: str) -> Column:
        given = [rows[named[a]] for a in ALIASES[field] if a in named]
        texts = [F.to_json(c) if isinstance(rows.schema[c_name].dataType, T.ArrayType) else F.nullif(F.trim(c.cast("string")), F.lit("")) for c, c_name in ((rows[named[a]], named[a]) for a in ALIASES[field] if a in named)]
        return F.coalesce(*texts) if given else F.lit(None).cast("string")

    return rows.select(F.col(order).alias("seq"), first("service_name").alias("service_name"), first("category").alias("category"), parse_synonyms(first("synonyms")).alias("synonyms"), first("icd_code").alias("icd_code"), valid_uuid(first("service_id")).alias("service_id"))


def from_json(texts: DataFrame) -> DataFrame:
    """texts: ``path, value`` (a whole file each), ``[...]`` or ``{"services": [...]}``."""
    fields = ", ".join(f"`{a}` string" for names in ALIASES.values() for a in names)
    inner = F.coalesce(F.get_json_object("value", "$.services"), F.col("value"))
    rows = texts.select("path", F.posexplode(F.from_json(inner, f"array<struct<{fields}>>")).alias("place", "r")).select(F.struct("path", "place").alias("seq"), "r.*")
    return from_table(rows)
