"""Table schemas, enumerations and thresholds."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(14, 2)
CONFIDENCE = T.DecimalType(5, 4)

# Fixed values.
FORMATS = ("pdf", "docx", "xlsx", "xls", "scan_pdf")
STATUSES = ("pending", "processing", "done", "error", "needs_review")
CURRENCIES = ("KZT", "USD", "RUB")
MATCH_METHODS = ("exact", "synonym", "fuzzy", "manual")
MATCH_AUTO, MATCH_SUGGEST = 0.85, 0.55
IMPLAUSIBLE_PRICE = 50_000_000
ANOMALY_SHARE = 0.50
STATIC_RATES = {"USD": "525", "RUB": "5.7"}
LAST_GOOD_RATES = {"USD": "486.47", "RUB": "6.26"}
RAW_CONTENT_CHARS, PARSE_LOG_LINES = 1_000_000, 2000
BOOTSTRAP_LIMIT, BOOTSTRAP_MIN_COUNT, BOOTSTRAP_SYNONYMS = 4000, 2, 19


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


_S, _B, _D, _TS = T.StringType(), T.BooleanType(), T.DateType(), T.TimestampType()

PARTNERS = _schema(partner_id=_S, name=_S, city=_S, address=_S, bin=_S, contact_email=_S, contact_phone=_S, is_active=_B, created_at=_TS, updated_at=_TS)
DOCUMENTS = _schema(doc_id=_S, partner_id=_S, file_name=_S, file_format=_S, effective_date=_D, parsed_at=_TS, parse_status=_S, parse_log=_S, raw_content=_S, content_sha256=_S)
ITEMS = _schema(
    item_id=_S, doc_id=_S, partner_id=_S, service_id=_S, service_name_raw=_S, name_norm=_S, service_code_source=_S, price_resident_kzt=MONEY, price_nonresident_kzt=MONEY, price_original=MONEY,
    price_extra_tiers=T.MapType(_S, MONEY), currency_original=_S, match_method=_S, match_confidence=CONFIDENCE, is_verified=_B, needs_review=_B, verification_note=_S, review_reasons=T.ArrayType(_S),
    section=_S, unit=_S, source_row=_S, effective_date=_D, is_active=_B, created_at=_TS,
)
SERVICES = _schema(service_id=_S, service_name=_S, synonyms=T.ArrayType(_S), category=_S, icd_code=_S, is_active=_B)
PARSED_ROW = _schema(
    name=_S, code=_S, unit=_S, section=_S, prices=T.ArrayType(T.DoubleType()), currency=_S, raw=_S, issues=T.ArrayType(_S), tariffs_resolved=_B, resident=T.DoubleType(), nonresident=T.DoubleType(),
    extra_tiers=T.MapType(_S, T.DoubleType()),
)
PARSED_FILE = _schema(path=_S, file_format=_S, rows=T.ArrayType(PARSED_ROW), raw_text=_S, price_labels=T.ArrayType(_S), warnings=T.ArrayType(_S))
TABLES = {"partners": PARTNERS, "price_documents": DOCUMENTS, "price_items": ITEMS, "services": SERVICES}


def empty(spark, name: str):
    """An empty table of the store: creating it twice changes nothing."""
    return spark.createDataFrame([], TABLES[name])
