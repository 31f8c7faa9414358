"""Matching names to a catalogue, and building and filling the catalogue."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import Choices
from ..functions.text import match_key
from ..schema import BOOTSTRAP_LIMIT, BOOTSTRAP_MIN_COUNT, BOOTSTRAP_SYNONYMS, MATCH_AUTO, MATCH_SUGGEST

#: Names and choices are compared block by block, in at most MOST_PARTS x MOST_PARTS tasks.
BLOCK_KEYS, BLOCK_CHOICES, MOST_PARTS = 250, 5_000, 64


def _first_of(rows: DataFrame, key: str, *order) -> DataFrame:
    return rows.withColumn("__nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__nth = 1").drop("__nth")


def choices(services: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(exact, any): key -> service_id by names, and by names and synonyms. On a collision the earliest service wins, in
    the order of ``seq``; a service's name comes before its synonyms."""
    active = services.where("is_active")
    names = active.select(match_key(F.col("service_name")).alias("key"), "service_id", F.col("seq"), F.lit(0).alias("place"))
    synonyms = active.select("service_id", "seq", F.posexplode(F.coalesce("synonyms", F.array().cast("array<string>"))).alias("place", "synonym")).select(match_key(F.col("synonym")).alias("key"), "service_id", "seq", (F.col("place") + 1).alias("place"))
    exact = _first_of(names, "key", "seq").select("key", "service_id")
    both = _first_of(names.unionByName(synonyms), "key", "seq", "place").select("key", "service_id", "seq", "place")
    return exact, both


def match_exact(items: DataFrame, services: DataFrame, key: str = "name_norm") -> DataFrame:
    """Adds service_id, match_method (exact, synonym or null) and match_confidence by equal keys."""
    exact, both = choices(services)
    found = items.join(exact.select(F.col("key").alias(key), F.col("service_id").alias("__exact")), key, "left").join(both.select(F.col("key").alias(key), F.col("service_id").alias("__any")), key, "left")
    method = F.when(F.col("__exact").isNotNull(), "exact").when(F.col("__any").isNotNull(), "synonym")
    return found.withColumn("service_id", F.coalesce("__exact", "__any")).withColumn("match_method", method).withColumn("match_confidence", F.when(method.isNotNull(), 1.0)).drop("__exact", "__any")


def best_fuzzy(keys: DataFrame, both: DataFrame, key: str = "name_norm") -> DataFrame:
    """(key, choice, score) of the best choice of each distinct key, the earliest on ties.

    At every size each key is compared with the whole catalogue, block by block; see :class:`Choices`."""
    asked, asked_parts = _blocks(keys.select(key).distinct(), key, BLOCK_KEYS, F.col(key))
    options = both.select(F.col("key").alias("choice"), "seq", "place")
    order = F.struct(F.col("seq").isNull().alias("last"), "seq", "place", "choice")
    against, against_parts = _blocks(options, "choice", BLOCK_CHOICES, order)
    pairs = asked.select(F.col("rows").alias("keys")).repartition(asked_parts).crossJoin(against.select("block", F.col("rows").alias("options")).repartition(against_parts).hint("shuffle_replicate_nl"))
    types = dict(options.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[Choices, pa.StructArray]] = {}
        for batch in batches:
            for n in range(batch.num_rows):
                block = batch.column(1)[n].as_py()
                if block not in known:
                    if len(known) >= 4:
                        known.clear()
                    rows = batch.column(2)[n].values
                    known[block] = Choices(rows.field("choice").to_pylist()), rows
                choices, rows = known[block]
                names = batch.column(0)[n].values
                found = [choices.best(name) for name in names.to_pylist()]
                best = rows.take(pa.array([i for i, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([names, *(best.field(c) for c in ("choice", "seq", "place")), pa.array([score for _, score in found], pa.float64())], ["name", "choice", "seq", "place", "score"])

    scored = pairs.select("keys", "block", "options").mapInArrow(run, f"name string, choice string, seq {types['seq']}, place {types['place']}, score double")
    best = F.max_by(F.struct("choice", "score"), F.struct(F.col("score"), F.struct(*[(-F.col(c)).alias(c) for c in ("seq", "place")])))
    return scored.groupBy(F.col("name").alias(key)).agg(best.alias("__best")).select(key, "__best.choice", "__best.score")


def _blocks(rows: DataFrame, by: str, size: int, value: Column) -> tuple[DataFrame, int]:
    """(block, rows: sorted values) of about ``size`` rows each, and in how many parts to deal them."""
    count = -(-rows.count() // size) or 1
    blocks = rows.groupBy(F.pmod(F.xxhash64(by), F.lit(count)).alias("block")).agg(F.collect_list(value).alias("rows"))
    return blocks.withColumn("rows", F.array_sort("rows")), min(count, MOST_PARTS)


def match_all(items: DataFrame, services: DataFrame, key: str = "name_norm") -> DataFrame:
    """Exact, then synonym, then fuzzy: linked from the auto threshold, suggested from the lower one. Thresholds hold
    for the unrounded score; the stored confidence has four places."""
    _, both = choices(services)
    matched = match_exact(items, services, key)
    fuzzy = best_fuzzy(matched.where("service_id is null"), both, key).join(both.select(F.col("key").alias("choice"), F.col("service_id").alias("__fuzzy")), "choice")
    share = F.col("score") / 100
    out = matched.join(fuzzy.select(key, "score", "__fuzzy"), key, "left")
    auto, open_ = F.col("service_id").isNull() & (share >= MATCH_AUTO), F.col("service_id").isNull()
    return (
        out.withColumn("suggestion_id", F.when(open_ & ~auto & (share >= MATCH_SUGGEST), F.col("__fuzzy")))
        .withColumn("match_method", F.when(auto, "fuzzy").otherwise(F.col("match_method")))
        .withColumn("match_confidence", F.when(open_, F.bround(share, 4)).otherwise(F.col("match_confidence")))
        .withColumn("service_id", F.when(auto, F.col("__fuzzy")).otherwise(F.col("service_id")))
        .drop("score", "__fuzzy")
    )


def bootstrap(items: DataFrame, existing_keys: DataFrame | None = None, min_count: int = BOOTSTRAP_MIN_COUNT, limit: int = BOOTSTRAP_LIMIT) -> DataFrame:
    """A catalogue out of active items: names seen at least ``min_count`` times; the most common spelling names the
    service, the next ones are synonyms, the most common section is its category. Ties go to the spelling seen first."""
    active = items.where("is_active")
    spellings = active.groupBy("name_norm", "name").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    by_use = Window.partitionBy("name_norm").orderBy(F.desc("n"), "first")
    ranked = spellings.withColumn("nth", F.row_number().over(by_use)).where(F.col("nth") <= BOOTSTRAP_SYNONYMS + 1)
    named = ranked.groupBy("name_norm").agg(
        F.min_by("name", "nth").alias("service_name"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") > 1, F.struct("nth", "name")))), lambda s: s["name"]).alias("synonyms"),
    )
    totals = spellings.groupBy("name_norm").agg(F.sum("n").alias("n"), F.min("first").alias("first")).where(F.col("n") >= min_count)
    sections = active.where("section is not null").groupBy("name_norm", "section").agg(F.count("*").alias("k"), F.min("seq").alias("f"))
    category = sections.groupBy("name_norm").agg(F.max_by("section", F.struct("k", F.lit(0))).alias("__any"), F.max("k").alias("k"))
    common = sections.join(category.select("name_norm", "k"), ["name_norm", "k"]).groupBy("name_norm").agg(F.min_by("section", "f").alias("category"))
    out = totals.join(named, "name_norm").join(common, "name_norm", "left")
    if existing_keys is not None:
        out = out.join(existing_keys.select(F.col("key").alias("name_norm")), "name_norm", "left_anti")
    return out.orderBy(F.desc("n"), "first").limit(limit).select("name_norm", "service_name", "synonyms", "category", "n")


def upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Services by normalised name: synonyms are united in order, category and code filled where null, a given id is kept
    on insert only; blank names are skipped. Adds ``is_new``."""
    given = incoming.where(F.coalesce(F.trim("service_name"), F.lit("")) != "").withColumn("key", match_key(F.col("service_name")))
    gathered = given.groupBy("key").agg(
        F.min_by("service_name", "seq").alias("in_name"),
        F.min_by("service_id", F.when(F.col("service_id").isNotNull(), F.col("seq"))).alias("in_id"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "synonyms"))), lambda s: F.coalesce(s["synonyms"], F.array().cast("array<string>"))))).alias("in_synonyms"),
        F.min_by("category", F.when(F.col("category").isNotNull(), F.col("seq"))).alias("in_category"),
        F.min_by("icd_code", F.when(F.col("icd_code").isNotNull(), F.col("seq"))).alias("in_icd"),
    )
    own = existing.withColumn("key", match_key(F.col("service_name")))
    none = F.array().cast("array<string>")
    return own.join(gathered, "key", "full_outer").select(
        "key",
        F.coalesce("service_id", "in_id", F.sha2("key", 256)).alias("service_id"),
        F.coalesce("service_name", "in_name").alias("service_name"),
        F.array_union(F.coalesce("synonyms", none), F.coalesce("in_synonyms", none)).alias("synonyms"),
        F.coalesce("category", "in_category").alias("category"),
        F.coalesce("icd_code", "in_icd").alias("icd_code"),
        F.col("service_name").isNull().alias("is_new"),
    )


def rematch_stats(before: DataFrame, after: DataFrame, only_unmatched: bool = True) -> DataFrame:
    """One row: considered, newly_matched, matched, items, rate."""
    looked_at = before.where("is_active" + (" and service_id is null" if only_unmatched else ""))
    joined = looked_at.select("item_id").join(after.select("item_id", F.col("service_id").alias("now")), "item_id")
    counted = joined.agg(F.count("*").alias("considered"), F.count_if(F.col("now").isNotNull()).alias("newly_matched"))
    total = after.where("is_active").agg(F.count("*").alias("items"), F.count_if(F.col("service_id").isNotNull()).alias("matched"))
    return counted.crossJoin(total).withColumn("rate", percent(F.col("matched"), F.col("items")))


def percent(part: Column, whole: Column) -> Column:
    """Rounded to one place; 0 of nothing."""
    return F.when(whole > 0, F.bround(part / whole * 100, 1)).otherwise(0.0)
