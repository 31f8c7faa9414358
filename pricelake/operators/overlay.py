"""Changes as events: facts are appended, edits are logs, and the current state is derived. Nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import reasons_text, without_llm_flags


def _last(value: Column, when: Column, seq: str = "seq") -> Column:
    return F.max_by(F.struct(value.alias("v")), F.when(when, F.col(seq)))


def with_matches(items: DataFrame, events: DataFrame) -> DataFrame:
    """Manual links, latest per item. events: item_id, seq, service_id (null unlinks), note (kept only if not empty)."""
    noted = F.coalesce("note", F.lit("")) != ""
    last = events.groupBy("item_id").agg(F.max_by(F.struct("service_id"), "seq").alias("__m"), _last(F.col("note"), noted).alias("__n"))
    found = items.join(last, "item_id", "left")
    hit, to = F.col("__m").isNotNull(), F.col("__m.service_id")
    return (
        found.withColumn("match_method", F.when(hit, F.when(to.isNotNull(), "manual")).otherwise(F.col("match_method")))
        .withColumn("match_confidence", F.when(hit, F.when(to.isNotNull(), 1.0)).otherwise(F.col("match_confidence")))
        .withColumn("service_id", F.when(hit, to).otherwise(F.col("service_id")))
        .withColumn("verification_note", F.coalesce(F.col("__n.v"), F.col("verification_note")))
        .drop("__m", "__n")
    )


def with_edits(items: DataFrame, events: DataFrame, fields: list[str]) -> DataFrame:
    """Field edits, the last one wins per field. events: item_id, seq, field, value (text, null is written too). The
    normalised name isn't computed again."""
    last = events.groupBy("item_id").agg(*[_last(F.col("value"), F.col("field") == f).alias(f"__e_{f}") for f in fields])
    out = items.join(last, "item_id", "left")
    for f in fields:
        out = out.withColumn(f, F.when(F.col(f"__e_{f}").isNotNull(), F.col(f"__e_{f}.v").cast(items.schema[f].dataType)).otherwise(F.col(f))).drop(f"__e_{f}")
    return out


def with_verifications(items: DataFrame, events: DataFrame) -> DataFrame:
    """Verdicts. events: item_id, seq, verified, price_resident, price_nonresident (null keeps), note. A positive one
    clears the review flag, not the reason."""
    last = events.groupBy("item_id").agg(
        F.max_by("verified", "seq").alias("__v"),
        F.max_by("price_resident", F.when(F.col("price_resident").isNotNull(), F.col("seq"))).alias("__r"),
        F.max_by("price_nonresident", F.when(F.col("price_nonresident").isNotNull(), F.col("seq"))).alias("__p"),
        F.max(F.col("verified").cast("int")).alias("__ever"),
    )
    found = items.join(last, "item_id", "left")
    return (
        found.withColumn("is_verified", F.coalesce("__v", "is_verified"))
        .withColumn("needs_review", F.col("needs_review") & (F.coalesce("__ever", F.lit(0)) == 0))
        .withColumn("price_resident", F.coalesce("__r", "price_resident"))
        .withColumn("price_nonresident", F.coalesce("__p", "price_nonresident"))
        .drop("__v", "__r", "__p", "__ever")
    )


def without_deleted(rows: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """Deleted rows go; with ``key`` doc_id, a document's items go with it."""
    return rows.join(tombstones.select(key), key, "left_anti")


def new_documents(incoming: DataFrame, stored: DataFrame, by: str = "content_sha256", order: str = "path") -> DataFrame:
    """Contents that aren't stored yet, the first path of each in this batch."""
    first = Window.partitionBy(by).orderBy(order)
    fresh = incoming.join(stored.select(by), by, "left_anti")
    return fresh.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth")


def new_partners(names: DataFrame, partners: DataFrame) -> DataFrame:
    """Partners to append: names that aren't there, with an id that is the same on every run."""
    fresh = names.select("name").distinct().join(partners.select("name"), "name", "left_anti")
    return fresh.select(F.sha2("name", 256).alias("partner_id"), "name", F.lit(True).alias("is_active"))


def manual_items(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows added by hand: the document's partner, active, to be reviewed, without key and versioning."""
    return rows.join(documents.select("doc_id", "partner_id"), "doc_id").withColumns(
        {"needs_review": F.lit(True), "review_reason": F.lit("manually added"), "is_active": F.lit(True), "is_verified": F.lit(False), "name_norm": F.lit(None).cast("string")}
    )


def recleaned(items: DataFrame, flags: DataFrame) -> DataFrame:
    """New cleaner flags replace old ones in the reason; the review flag follows for items not verified. flags: item_id,
    flags array<string>."""
    kept = without_llm_flags(F.col("review_reason"))
    fresh = F.transform(F.coalesce("flags", F.array().cast("array<string>")), lambda f: F.concat(F.lit("LLM: "), f))
    both = F.concat(kept, fresh)
    return (
        items.join(flags.select("item_id", "flags"), "item_id", "left")
        .withColumn("review_reason", reasons_text(both))
        .withColumn("needs_review", F.when(F.col("is_verified"), F.col("needs_review")).otherwise(F.col("review_reason").isNotNull()))
        .drop("flags")
    )


def last_good(rates: DataFrame) -> DataFrame:
    """Of saved rates (code, per_unit, saved_at) the latest per code."""
    return rates.groupBy("code").agg(F.max_by("per_unit", "saved_at").alias("per_unit"))


def archived_name(sha: Column, path: Column) -> Column:
    """What the original is kept as: 16 digits of its hash and its base name."""
    return F.concat(F.substring(sha, 1, 16), F.lit("__"), F.element_at(F.split(path, "/"), -1))
