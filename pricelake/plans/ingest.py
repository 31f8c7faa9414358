"""From files to versioned, validated and matched price rows, as one lazy plan."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tariffs import map_tariffs, sane, sane_reason, tiers_to_kzt, to_kzt
from ..functions.text import clean_section, match_key
from ..operators import grid, matching, pages, quality
from ..operators.statistics import ingest_report
from ..operators.versions import fold, version_key
from ..schema import IMPLAUSIBLE_PRICE
from ..sources import archives, formats, model_rows, office


def parsed_rows(files: DataFrame) -> DataFrame:
    """Rows of spreadsheets and word-processor tables (``path, content, file_format``), with their tiers mapped. The labels
    of a document are those of its first sheet that has any."""
    lines = office.lines(files).where("error is null")
    rows = grid.interpret(lines)
    rows = rows.drop("price_labels").join(grid.document_labels(rows), "doc_id", "left")
    tiers = map_tariffs(F.col("prices"), F.coalesce("price_labels", F.array().cast("array<string>")))
    return rows.withColumn("__t", tiers).select("doc_id", F.concat_ws("/", "sheet", F.lpad(F.col("row_idx").cast("string"), 8, "0")).alias("place"), "name", "code", "unit", "section", "raw", F.lit("KZT").alias("currency"), F.col("__t.resident").alias("resident"), F.col("__t.nonresident").alias("nonresident"), F.col("__t.extra").alias("tiers"))


_ROWS = ["doc_id", "place", "name", "code", "unit", "section", "raw", "currency", "resident", "nonresident", "tiers", "issues"]


def page_rows(words: DataFrame, scanned: bool = False) -> DataFrame:
    """Rows of pages of positioned words (see :mod:`..operators.pages`), with their tiers mapped where no columns told them;
    a row whose columns don't match the header page's has prices but no resident's, and says so."""
    rows = pages.scan_rows(words) if scanned else pages.text_rows(words)
    t = F.when(F.col("tariffs_resolved"), F.struct("resident", "nonresident", F.col("extra_tiers").alias("extra"))).otherwise(map_tariffs(F.col("prices"), F.array().cast("array<string>")))
    place = F.concat_ws("/", F.lpad(F.col("page").cast("string"), 6, "0"), F.lpad(F.col("row").cast("string"), 8, "0"))
    return rows.withColumn("__t", t).select("doc_id", place.alias("place"), "name", "code", "unit", "section", "raw", "currency", F.col("__t.resident").alias("resident"), F.col("__t.nonresident").alias("nonresident"), F.col("__t.extra").alias("tiers"), F.array().cast("array<string>").alias("issues"))


def answer_rows(answers: DataFrame) -> DataFrame:
    """Rows of language models' answers (``doc_id, answer``)."""
    found = model_rows.rows(answers)
    return found.select("doc_id", F.lpad(F.col("place").cast("string"), 8, "0").alias("place"), "name", "code", "unit", "section", F.lit(None).cast("string").alias("raw"), "currency", "resident", "nonresident", F.col("extra_tiers").alias("tiers"), F.array().cast("array<string>").alias("issues"))


def bundled(files: DataFrame) -> DataFrame:
    """Files (``path, content, file_format``) with zip bundles replaced by their members, whose paths go on from the
    bundle's; a bundle that is refused stays, as a file of format ``refused``."""
    zipped = F.col("file_format") == "zip"
    members = archives.documents(files.where(zipped))
    path = F.when(F.col("error").isNull(), F.concat_ws("/", "archive", "path")).otherwise(F.col("archive"))
    inside = members.select(path.alias("path"), "content", F.when(F.col("error").isNotNull(), "refused").otherwise(F.coalesce(formats.file_format(F.col("path")), formats.suffix(F.col("path")))).alias("file_format"))
    return files.where(~zipped | F.col("file_format").isNull()).select("path", "content", "file_format").unionByName(inside)


def all_rows(files: DataFrame, words: DataFrame | None = None, scans: DataFrame | None = None, answers: DataFrame | None = None) -> DataFrame:
    """Rows of everything that can be read here: files, bundles, words of text layers and of recognised pages, and answers."""
    parts = [parsed_rows(bundled(files)).withColumn("issues", F.array().cast("array<string>"))]
    parts += [page_rows(words)] if words is not None else []
    parts += [page_rows(scans, scanned=True)] if scans is not None else []
    parts += [answer_rows(answers)] if answers is not None else []
    return reduce(DataFrame.unionByName, [p.select(*_ROWS) for p in parts])


def documents(files: DataFrame) -> DataFrame:
    """doc_id, partner, file_format, effective_date, content_sha256 of files that are new by content."""
    path = F.col("path")
    return files.select(path.alias("doc_id"), formats.partner_name(path).alias("partner"), "file_format", formats.effective_date(path).alias("effective_date"), F.sha2("content", 256).alias("content_sha256"))


def items(rows: DataFrame, docs: DataFrame, services: DataFrame, rates: DataFrame, as_of: date) -> DataFrame:
    """Priced, versioned, validated and matched items. rows: as :func:`parsed_rows`, with optional ``issues``."""
    named = rows.where(~quality.droppable_name(F.col("name"))).join(docs.select("doc_id", F.col("partner").alias("partner_id"), "effective_date"), "doc_id")
    priced = named.join(F.broadcast(rates.select(F.col("code").alias("currency"), "per_unit")), "currency", "left")
    in_kzt = {c: to_kzt(F.col(c), F.col("currency"), F.col("per_unit")) for c in ("resident", "nonresident")}
    issues = F.filter("issues", lambda i: i.startswith("LLM:")) if "issues" in rows.columns else F.array().cast("array<string>")
    header = F.when(quality.header_row(F.col("name")), "row resembles a table header (possible misparse)")
    priced = (
        priced.withColumn("more_reasons", F.concat(F.array(sane_reason(in_kzt["resident"], "resident"), sane_reason(in_kzt["nonresident"], "nonresident"), header), issues))
        .withColumn("price_original", F.when(F.col("resident") <= IMPLAUSIBLE_PRICE, F.col("resident")))
        .withColumn("tiers", tiers_to_kzt(F.col("tiers"), F.col("currency"), F.col("per_unit")))
        .withColumn("price_resident", sane(in_kzt["resident"]).cast("double"))
        .withColumn("price_nonresident", sane(in_kzt["nonresident"]).cast("double"))
        .withColumn("name_norm", match_key(F.col("name")))
        .withColumn("section", clean_section(F.col("section")))
        .withColumn("seq", F.concat_ws("/", "doc_id", "place"))
        .withColumn("item_id", F.sha2("seq", 256))
        .withColumn("version_key", version_key(F.col("code"), F.col("name_norm")))
        .drop("per_unit", "resident", "nonresident")
    )
    folded = fold(priced, ["partner_id", "version_key"], ["seq"])
    checked = quality.validated(folded, as_of, F.col("more_reasons")).drop("more_reasons")
    return matching.match_all(checked, services).withColumn("is_verified", F.lit(False)).withColumn("verification_note", F.lit(None).cast("string"))


def report(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Counters and status of each document."""
    dropped = rows.where(quality.droppable_name(F.col("name"))).select("doc_id", F.lit(True).alias("dropped"), F.lit(False).alias("needs_review"), F.lit(None).cast("string").alias("service_id"))
    return ingest_report(stored.select("doc_id", F.lit(False).alias("dropped"), "needs_review", "service_id").unionByName(dropped))


