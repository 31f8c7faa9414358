"""From files to a store, and the store's questions and edits."""

from datetime import date

import pytest
from pyspark.sql import functions as F
from test_sources import zipped

from pricelake.operators.rates import literal_rates
from pricelake.operators.statistics import list_gaps
from pricelake.plans import ingest
from pricelake.plans.store import PriceStore

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def sheet(*rows):
    cells = lambda r, row: "".join(f'<c r="{chr(65 + i)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for i, v in enumerate(row) if v)
    body = "".join(f'<row r="{r}">{cells(r, row)}</row>' for r, row in enumerate(rows, 1))
    return zipped({"xl/workbook.xml": f'<workbook {MAIN} xmlns:r="{REL}"><sheets><sheet name="s" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<R><Relationship Id="r1" Target="worksheets/sheet1.xml"/></R>', "xl/worksheets/sheet1.xml": f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>"})


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    head = ["Код", "Наименование услуги", "Цена резидент, тг", "Цена нерезидент, тг"]
    files = [
        ("/in/Клиника 1 2023.xlsx", sheet(head, ["Раздел 1.Анализы"], ["A1", "ОАК", "1 000", "1 500"], ["A2", "УЗИ сердца", "5000", "4000"], ["A3", "-", "7", "8"])),
        ("/in/Клиника 1 2024.xlsx", sheet(head, ["A1", "ОАК", "1 700", "2 000"], ["A4", "Особая услуга", "60 000 000", ""])),
    ]
    df = spark.createDataFrame([(p, bytearray(c), "xlsx") for p, c in files], "path string, content binary, file_format string")
    services = spark.createDataFrame([(1, "S1", "Общий анализ крови", ["кровь"], "lab", None, True), (2, "S2", "Ультразвуковое исследование сердца", [], "us", None, True)], "seq int, service_id string, service_name string, synonyms array<string>, category string, icd_code string, is_active boolean")
    rows, docs = ingest.parsed_rows(df), ingest.documents(df)
    items = ingest.items(rows, docs, services, literal_rates(spark, {"USD": "500"}), date(2024, 6, 1))
    report = ingest.report(rows, items)
    s = PriceStore(spark, str(tmp_path_factory.mktemp("store")))
    s.append("services", services)
    s.append("partners", docs.select(F.col("partner").alias("partner_id"), F.col("partner").alias("name"), F.lit("Алматы").alias("city"), F.lit(True).alias("is_active")).distinct())
    s.append("documents", docs.withColumnRenamed("partner", "partner_id").join(report.select("doc_id", F.col("status").alias("parse_status")), "doc_id").withColumn("parsed_at", F.lit("2024-01-01").cast("timestamp")))
    s.append("items", items)
    return s


def by_code(items):
    return {(r["code"], r["effective_date"].year): r for r in items.collect()}


def test_ingest(store):
    got = by_code(store.read("items"))
    assert got.keys() == {("A1", 2023), ("A2", 2023), ("A1", 2024), ("A4", 2024)}
    assert (got["A1", 2023]["is_active"], got["A1", 2024]["is_active"]) == (False, True)
    assert got["A1", 2024]["review_reason"] == "price changed 70% vs previous version"
    assert got["A2", 2023]["review_reason"] == "nonresident price lower than resident"
    assert got["A4", 2024]["review_reason"].startswith("price missing or not positive; resident price implausible")
    assert [got["A1", 2024][c] for c in ("service_id", "match_method", "section")] == ["S1", "exact", None]
    assert got["A1", 2023]["section"] == "Раздел 1. Анализы" and got["A4", 2024]["service_id"] is None
    assert {r["parse_status"] for r in store.documents().collect()} == {"needs_review"}


def test_questions(store):
    assert [r["price_resident"] for r in store.service_partners("S1").collect()] == [1700.0]
    assert store.partners(q="клиника").count() == 1 and store.partner("Клиника 1").count() == 1 and store.services(q="анализ").count() == 1
    assert {k: v.count() for k, v in store.search("оак").items()} == {"partners": 0, "services": 0, "items": 1}
    assert store.queue("unmatched").count() == 1 and store.queue("review").count() == 3 and store.queue("flagged").count() == 0
    assert store.partner_services("Клиника 1", aggregate=True).count() == 3 and store.document_items("/in/Клиника 1 2024.xlsx").count() == 2
    s = store.stats().first()
    assert (s["items"], s["matched"], s["documents"], s["match_rate"]) == (4, 3, 2, 75.0)
    item = by_code(store.items())["A1", 2024]["item_id"]
    assert store.item_history(item).count() == 1 and store.item_history(item, include_inactive=True).count() == 2
    assert store.bootstrap(min_count=1).count() == 1


def test_edits(store):
    ids = {k: r["item_id"] for k, r in by_code(store.items()).items()}
    assert store.match([ids["A4", 2024], "nobody"], "S2", "by hand") == 1
    with pytest.raises(KeyError):
        store.match([ids["A4", 2024]], "nothing")
    store.patch_item(ids["A4", 2024], name="Иная", section=None)
    store.verify_item(ids["A4", 2024], price_resident=10.0)
    got = by_code(store.items())["A4", 2024]
    assert [got[c] for c in ("service_id", "match_method", "name", "price_resident", "is_verified", "needs_review", "verification_note")] == ["S2", "manual", "Иная", 10.0, True, False, "by hand"]
    store.add_item(store.spark.createDataFrame([("/in/Клиника 1 2024.xlsx", "m1", "Ручная", 3.0)], "doc_id string, item_id string, name string, price_resident double"))
    added = store.items().where("item_id = 'm1'").first()
    assert added["needs_review"] and added["review_reason"] == "manually added" and added["partner_id"] == "Клиника 1"
    store.delete_item("m1")
    assert store.delete_document("/in/Клиника 1 2023.xlsx") == 2 and store.items().count() == 2
    after, counters = store.rematch(only_unmatched=False)
    assert counters.first()["considered"] == after.where("is_active").count()


def test_gaps(spark):
    r = list_gaps(spark.createDataFrame([("d", "a", "s", 1), ("d", "a", "t", 2), ("d", None, "t", 5)], "d string, code string, section string, page int"), ["d"]).first()
    assert (r["rows"], r["duplicate_codes"], r["sections"], sorted(r["missing_pages"])) == (3, 1, 2, [3, 4])
