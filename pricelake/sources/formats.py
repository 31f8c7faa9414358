"""What a file is, and what its name says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import year_of_name

SUPPORTED = ("pdf", "docx", "xlsx", "xls", "doc")
TEXT_CHARS_PER_PAGE, TEXT_PAGES = 200, 5


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"^.+\.([^.]+)$", 1))


def file_format(path: Column) -> Column:
    """By suffix; a pdf may turn out to be a scan (:func:`classify_pdf`); null for what isn't supported."""
    s = suffix(path)
    return F.when(s.isin("docx", "xlsx", "xls", "pdf"), s)


def classify_pdf(pages: DataFrame) -> DataFrame:
    """(doc_id, file_format): pdf if the first five pages hold 200 characters each on average, else scan_pdf."""
    chars = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", ""))
    return pages.where(F.col("page") < TEXT_PAGES).groupBy("doc_id").agg(F.when(F.avg(chars) >= TEXT_CHARS_PER_PAGE, "pdf").otherwise("scan_pdf").alias("file_format"))


def partner_name(path: Column) -> Column:
    """``Клиника N`` if the name has it, else the stem without years and list words."""
    s = stem(path)
    number = F.regexp_extract(s, r"(?iu)клиника\s*(\d+)", 1)
    cleaned = F.regexp_replace(F.regexp_replace(s, r"[_\-]+", " "), r"(19|20)\d{2}", "")
    cleaned = F.regexp_replace(cleaned, r"(?iuU)\b(прайс|price|прейскурант|год[а]?)\b", "")
    cleaned = F.regexp_replace(F.regexp_replace(cleaned, r"(?U)\s+", " "), r"^[ .,\-]+|[ .,\-]+$", "")
    return F.when(number != "", F.concat(F.lit("Клиника "), number)).when(cleaned != "", cleaned).otherwise(s)


def effective_date(path: Column) -> Column:
    """The first of January of the latest year 2000 .. 2100 in the name."""
    return year_of_name(stem(path))


def documents(spark, folder: str) -> DataFrame:
    """Files under a folder, recursively: path, content and its hash, format and what the name says."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(suffix(F.col("path")).isin(*SUPPORTED, "zip"))
    return files.select("path", "content", F.sha2("content", 256).alias("content_sha256"), file_format(F.col("path")).alias("file_format"), partner_name(F.col("path")).alias("partner"), effective_date(F.col("path")).alias("effective_date"))
