"""A price store in a folder of tables: facts are appended, edits are event logs, reads are derived views. Every question
and every edit of the service has its method here; reads return DataFrames."""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import match_key
from ..operators import history, matching, overlay, queries, statistics
from ..operators.rates import display_rate

_EVENTS = {
    "matches": "item_id string, seq long, service_id string, note string",
    "edits": "item_id string, seq long, field string, value string",
    "verifications": "item_id string, seq long, verified boolean, price_resident double, price_nonresident double, note string",
    "deleted_items": "item_id string, seq long",
    "deleted_documents": "doc_id string, seq long",
}
EDITABLE = ["name", "section", "unit", "code", "price_resident", "price_nonresident"]


class PriceStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # ------------------------------------------------------------ storage

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        try:
            return reader.parquet(f"{self.folder}/{name}")
        except Exception as e:  # noqa: BLE001  a table that nothing was written to yet
            if schema and "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.folder}/{name}")

    def _log(self, name: str, rows: Iterable[tuple]) -> None:
        """Events of one call, numbered by its time: later calls win."""
        now = time.time_ns()
        self.append(name, self.spark.createDataFrame([(r[0], now, *r[1:]) for r in rows], _EVENTS[name]))

    def _events(self, name: str) -> DataFrame:
        return self.read(name, _EVENTS[name])

    # ------------------------------------------------------------ views

    def items(self) -> DataFrame:
        """Current items: facts with all edits applied, without what was deleted."""
        out = overlay.without_deleted(self.read("items"), self._events("deleted_items"), "item_id")
        out = overlay.without_deleted(out, self._events("deleted_documents"), "doc_id")
        out = overlay.with_matches(out, self._events("matches"))
        out = overlay.with_edits(out, self._events("edits"), [f for f in EDITABLE if f in out.columns])
        return overlay.with_verifications(out, self._events("verifications"))

    def all_documents(self) -> DataFrame:
        return overlay.without_deleted(self.read("documents"), self._events("deleted_documents"), "doc_id")

    def documents(self, status: str = "", partner_id: str = "", limit: int = 500) -> DataFrame:
        return queries.page(queries.where_given(self.all_documents(), parse_status=status, partner_id=partner_id), [F.desc("parsed_at"), F.asc("doc_id")], limit, most=5000)

    def partners(self, city: str = "", q: str = "", is_active: bool | None = None, limit: int = 200, offset: int = 0) -> DataFrame:
        own = queries.where_flag(self.read("partners"), "is_active", is_active)
        for column, value in (("city", city), ("name", q)):
            own = own.where(F.col(column).ilike(f"%{value}%")) if value else own
        return queries.page(own, [F.asc_nulls_last("name"), F.asc("partner_id")], limit, offset, 2000)

    def partner(self, partner_id: str) -> DataFrame:
        return self.read("partners").where(F.col("partner_id") == partner_id)

    def services(self, category: str = "", q: str = "", limit: int = 100, offset: int = 0) -> DataFrame:
        own = queries.where_given(self.read("services"), category=category)
        own = own.where(F.col("service_name").ilike(f"%{q}%")) if q else own
        return queries.page(own, [F.asc_nulls_last("service_name"), F.asc("service_id")], limit, offset, 1000)

    def service_partners(self, service_id: str) -> DataFrame:
        return queries.offers(self.items(), self.read("partners"), self.read("services").where(F.col("service_id") == service_id).select("service_id"))

    def partner_services(self, partner_id: str, active_only: bool = True, aggregate: bool = False, limit: int = 500, offset: int = 0) -> DataFrame:
        own = queries.price_list(self.items(), partner_id, active_only, limit, offset)
        return queries.merged(own).orderBy("seq") if aggregate else own

    def document_items(self, doc_id: str, aggregate: bool = False, limit: int = 2000) -> DataFrame:
        own = queries.page(self.items().where(F.col("doc_id") == doc_id), [F.asc_nulls_last("section"), F.asc_nulls_last("name"), F.asc("seq")], limit, most=10_000)
        return queries.merged(own).orderBy("seq") if aggregate else own

    def search(self, q: str, limit: int = 50) -> dict[str, DataFrame]:
        """Partners, services and items that hold the query."""
        key = self.spark.range(1).select(match_key(F.lit(q)).alias("k")).first()["k"]
        items = queries.with_partner(queries.search_items(self.items(), q, key), self.read("partners"))
        return {
            "partners": self.partners(q=q, limit=limit),
            "services": self.services(q=q, limit=limit),
            "items": queries.page(items, [F.asc("name_norm"), F.asc_nulls_last("price_resident"), F.asc("seq")], limit, most=500),
        }

    def queue(self, kind: str, limit: int = 200) -> DataFrame:
        """unmatched, review or flagged, the surest matches first."""
        own = {"unmatched": queries.unmatched, "review": queries.review, "flagged": queries.flagged}[kind](self.items())
        return queries.page(queries.with_partner(own, self.read("partners")), [F.desc_nulls_last("match_confidence"), F.asc("seq")], limit, most=2000)

    def item_history(self, item_id: str, include_inactive: bool = False) -> DataFrame:
        items = self.items()
        seed = items.where(F.col("item_id") == item_id).first()
        if seed is None:
            raise KeyError(item_id)
        own = history.related(items, seed["code"], seed["name_norm"], seed["name"], seed["partner_id"], include_inactive)
        return history.points(own, ["partner_id"], ["seq"]).orderBy("effective_date")

    def stats(self) -> DataFrame:
        return statistics.overview(self.all_documents(), self.read("partners"), self.read("services"), self.items())

    def rates(self) -> DataFrame:
        return self.read("rates").withColumn("per_unit", display_rate(F.col("per_unit")))

    # ------------------------------------------------------------ edits

    def match(self, item_ids: list[str], service_id: str | None, note: str = "") -> int:
        """Links items to a service by hand, or unlinks them; how many of them there are."""
        if service_id is not None and self.read("services").where(F.col("service_id") == service_id).isEmpty():
            raise KeyError(service_id)
        found = [r["item_id"] for r in self.items().where(F.col("item_id").isin(item_ids)).select("item_id").collect()]
        if not found:
            raise KeyError(item_ids)
        self._log("matches", [(i, service_id, note) for i in found])
        return len(found)

    def patch_item(self, item_id: str, **fields) -> None:
        """Writes the fields that are given, null included."""
        if unknown := set(fields) - set(EDITABLE):
            raise ValueError(f"not editable: {sorted(unknown)}")
        self._log("edits", [(item_id, f, None if v is None else str(v)) for f, v in fields.items()])

    def verify_item(self, item_id: str, verified: bool = True, price_resident: float | None = None, price_nonresident: float | None = None, note: str = "") -> None:
        self._log("verifications", [(item_id, verified, price_resident, price_nonresident, note)])

    def delete_item(self, item_id: str) -> None:
        self._log("deleted_items", [(item_id,)])

    def delete_document(self, doc_id: str) -> int:
        """Deletes a document with its items; how many those were."""
        n = self.items().where(F.col("doc_id") == doc_id).count()
        self._log("deleted_documents", [(doc_id,)])
        return n

    def add_item(self, rows: DataFrame) -> None:
        """Rows by hand (doc_id, item_id, name, code, prices): active, to be reviewed, not versioned."""
        stored = self.read("items")
        own = overlay.manual_items(rows, self.read("documents"))
        given = [F.col(c).cast(stored.schema[c].dataType).alias(c) if c in own.columns else F.lit(None).cast(stored.schema[c].dataType).alias(c) for c in stored.columns]
        self.append("items", own.select(*given))

    def import_services(self, incoming: DataFrame) -> DataFrame:
        """The catalogue after an import, to be written as its next version."""
        existing = self.read("services").select("service_id", "service_name", "synonyms", "category", "icd_code")
        return matching.upsert(existing, incoming)

    def bootstrap(self, min_count: int = 2) -> DataFrame:
        known = self.read("services").select(match_key(F.col("service_name")).alias("key"))
        return matching.bootstrap(self.items(), known, min_count)

    def rematch(self, only_unmatched: bool = True) -> tuple[DataFrame, DataFrame]:
        """(items as matched anew, counters)."""
        before = self.items()
        considered = before.where("is_active" + (" and service_id is null" if only_unmatched else ""))
        plain = considered.drop("service_id", "match_method", "match_confidence", "suggestion_id")
        again = matching.match_all(plain, self.read("services")).drop("suggestion_id")
        rest = before.join(considered.select("item_id"), "item_id", "left_anti")
        after = rest.unionByName(again, allowMissingColumns=True)
        return after, matching.rematch_stats(before, after, only_unmatched)
