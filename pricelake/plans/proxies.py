"""The price-list tables out of the star-schema tables: suppliers are partners, parts are services, line items are price
rows in three currencies, and a supplier's rows of one year are a document."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tariffs import sane
from ..functions.text import match_key
from ..operators import quality, rates
from ..operators.statistics import ingest_report
from ..operators.versions import fold
from ..schema import LAST_GOOD_RATES

#: "Today" of the tests of dates.
AS_OF = date(1998, 6, 1)
MONEY, SHARE = "decimal(14,2)", "decimal(4,2)"


def item_id() -> Column:
    """A row's id, out of the columns it is made of."""
    return F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), "code", "partner_id", F.date_format("effective_date", "yyyyMMdd"), F.col("price_original").cast("string"))


@dataclass
class Proxies:
    spark: SparkSession
    sf_dir: str
    #: In place of all line items.
    lines: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        if name == "lineitem" and self.lines is not None:
            return self.lines
        return self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")

    @cached_property
    def parts(self) -> DataFrame:
        return self.table("part").withColumn("name_norm", match_key(F.col("p_name")))  # once per part, not per row

    def rows_of(self, parts: DataFrame, *more: str) -> DataFrame:
        """Rows as they were parsed, of these parts, with further columns of theirs."""
        share = F.lit(1).cast(SHARE) + F.col("l_tax").cast(SHARE) - F.col("l_discount").cast(SHARE)
        other = F.round(F.col("price_original") * F.col("__share"), 2).cast(MONEY)
        currency = F.when(F.col("l_returnflag") == "A", "KZT").when(F.col("l_returnflag") == "N", "USD").otherwise("RUB")
        # What the join exchanges is narrow: decimals and days, no text but the currency.
        line = self.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("effective_date"), F.col("l_extendedprice").cast(MONEY).alias("price_original"), "l_linenumber", share.alias("__share"), currency.alias("currency"))
        joined = line.join(parts, line["l_partkey"] == parts["p_partkey"])
        rows = joined.select(
            "l_orderkey",
            "l_partkey",
            F.col("l_suppkey").alias("partner_id"),
            F.concat_ws("-", "l_suppkey", F.year("effective_date")).alias("doc_id"),
            F.col("l_partkey").cast("string").alias("code"),
            F.col("p_name").alias("name"),
            "name_norm",
            F.col("p_type").alias("section"),
            F.col("p_brand").alias("unit"),
            "currency",
            "price_original",
            other.alias("nonresident_original"),
            "effective_date",
            "l_linenumber",
            *more,
        )
        return rows.select(item_id().alias("item_id"), item_id().alias("seq"), "*")

    @cached_property
    def base(self) -> DataFrame:
        """Rows as they were parsed: prices in their own currency, tiers, and a sequence that sorts."""
        return self.rows_of(self.parts)

    @cached_property
    def rates(self) -> DataFrame:
        return rates.literal_rates(self.spark, LAST_GOOD_RATES)

    @cached_property
    def priced(self) -> DataFrame:
        return self.in_tenge(self.base)

    def in_tenge(self, rows: DataFrame) -> DataFrame:
        """Prices in tenge, implausible ones cleared, as doubles."""
        own = rows.withColumn("price_resident", F.col("price_original")).withColumn("price_nonresident", F.col("nonresident_original"))
        converted = rates.convert(own, self.rates, ["price_resident", "price_nonresident"])
        return converted.withColumns({c: sane(F.col(c)).cast("double") for c in ("price_resident", "price_nonresident")})

    @cached_property
    def folded(self) -> DataFrame:
        return self.versions(self.priced)

    def versions(self, priced: DataFrame) -> DataFrame:
        """By the part's number in place of its code, the same text: so rows stay where the join with parts put them."""
        return fold(priced, ["partner_id", "l_partkey"], ["seq"])

    @cached_property
    def services(self) -> DataFrame:
        """Two thirds of the part names, the rest stay unmatched."""
        named = self.table("part").where(F.length("p_name") % 3 != 0).groupBy("p_name").agg(F.min("p_partkey").alias("seq"), F.min("p_type").alias("category"))
        return named.select("seq", F.concat(F.lit("S"), F.col("seq")).alias("service_id"), F.col("p_name").alias("service_name"), "category", F.array(F.concat("p_name", F.lit(" std"))).alias("synonyms"), F.lit(True).alias("is_active"))

    @cached_property
    def items(self) -> DataFrame:
        """Versioned, validated and matched by exact name. Services meet the parts, not the rows; a row of a name of several
        is there once for each."""
        known = self.services.groupBy(F.lower("service_name").alias("name_norm")).agg(F.collect_list("service_id").alias("service_ids"))
        rows = self.rows_of(self.parts.join(known, "name_norm", "left"), "service_ids")
        out = quality.validated(self.versions(self.in_tenge(rows)), AS_OF)
        out = out.select("*", F.explode_outer("service_ids").alias("service_id")).drop("service_ids")
        matched = F.col("service_id").isNotNull()
        return out.withColumn("is_verified", F.col("l_linenumber") == 7).withColumn("match_method", F.when(matched, "exact")).withColumn("match_confidence", F.when(matched, 1.0))

    @cached_property
    def partners(self) -> DataFrame:
        supplier, nation = self.table("supplier"), self.table("nation")
        return supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select(F.col("s_suppkey").alias("partner_id"), F.col("s_name").alias("name"), F.col("n_name").alias("city"), (F.col("s_acctbal") >= 0).alias("is_active"))

    @cached_property
    def reports(self) -> DataFrame:
        return ingest_report(self.items.select("doc_id", (F.col("l_linenumber") == 6).alias("dropped"), "needs_review", "service_id"))

    @cached_property
    def documents(self) -> DataFrame:
        own = self.priced.groupBy("doc_id").agg(F.min("partner_id").alias("partner_id"), F.make_date(F.year(F.min("effective_date")), F.lit(1), F.lit(1)).alias("effective_date"))
        kind = F.when(F.col("partner_id") % 2 == 0, "xlsx").otherwise("pdf")
        return own.join(self.reports.select("doc_id", F.col("status").alias("parse_status")), "doc_id").withColumn("file_format", kind).withColumn("parsed_at", F.col("effective_date").cast("timestamp"))
