"""Readers on files written here."""

import io
import json
import zipfile

import pytest

from pricelake.sources import archives, engines, formats, office, rate_feed
from pricelake.sources import catalogue as catalogue_files
from pricelake.sources import golden as golden_files
from pricelake.sources import model_rows

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def zipped(files: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def xlsx() -> bytes:
    return zipped({
        "xl/workbook.xml": f'<workbook {MAIN} xmlns:r="{REL}"><sheets><sheet name="Лист" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {MAIN}><si><t>Наименование</t></si><si><r><t>Це</t></r><r><t>на</t></r></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {MAIN}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="A3" t="inlineStr"><is><t>УЗИ</t></is></c><c r="C3"><v>1200</v></c></row></sheetData></worksheet>',
    })


def docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = "<w:tc><w:p>{}</w:p></w:tc>"
    run = "<w:r><w:t>{}</w:t></w:r>"
    row = cell.format(run.format("УЗИ") + "<w:ins>" + run.format(" сердца") + "</w:ins><w:del><w:r><w:delText>x</w:delText></w:r></w:del>") + cell.format(run.format("500"))
    return zipped({"word/document.xml": f"<w:document {w}><w:body><w:tbl><w:tr>{row}</w:tr></w:tbl></w:body></w:document>"})


def test_office(spark):
    files = spark.createDataFrame([("a.xlsx", bytearray(xlsx()), "xlsx"), ("b.docx", bytearray(docx()), "docx"), ("c.xlsx", bytearray(b"no"), "xlsx")], "path string, content binary, file_format string")
    got = office.lines(files).orderBy("doc_id", "row_idx").collect()
    assert [(r["doc_id"], r["row_idx"], r["cells"]) for r in got[:3]] == [("a.xlsx", 0, ["Наименование", "", "Цена"]), ("a.xlsx", 2, ["УЗИ", "", "1200"]), ("b.docx", 0, ["УЗИ сердца", "500"])]
    assert got[3]["doc_id"] == "c.xlsx" and got[3]["error"]


def test_archives(spark):
    inner = zipped({"Клиника 9.docx": "x"})
    good = zipped({"a.pdf": "1", "sub/b.xlsx": "2", "c.xls": "3", "d.doc": "4", "notes.txt": "5", "__MACOSX/e.pdf": "6", "._hidden.pdf": "7", "inner.zip": inner, "broken.zip": "no"})
    assert [n.rsplit("/", 1)[-1] for n, _ in archives.members(good)] == ["a.pdf", "c.xls", "d.doc", "Клиника 9.docx", "b.xlsx"]
    with pytest.raises(ValueError, match="unsafe"):
        archives.members(zipped({"../escape.txt": "x"}))
    info = zipfile.ZipInfo("Клиника.pdf".encode("cp866").decode("cp437"))
    assert archives.member_name(info) == "Клиника.pdf"
    rows = archives.documents(spark.createDataFrame([("x.zip", bytearray(good)), ("y.zip", bytearray(zipped({"../e.pdf": "x"})))], "path string, content binary")).collect()
    assert sum(r["error"] is None for r in rows) == 5 and sum(r["archive"] == "y.zip" and "unsafe" in (r["error"] or "") for r in rows) == 1


def test_rate_feeds(spark):
    item = lambda code, value, quant, day="": f"<item><title>{code}</title>{day}<description>{value}</description><quant>{quant}</quant><index>UP</index></item>"
    day = "<pubDate>12.02.2025</pubDate>"
    rss = '<?xml version="1.0" encoding="utf-8"?><rss version="2.0"><channel><title>x</title>' + item("usd", "486,47", 1, day) + item("AMD", "13.23", 10, day) + item("JPY", "3.42", 100, day) + item("BAD", "n/a", 1, day) + item("Z", "2", 0, day) + item("E", "2", "abc", day) + "</channel></rss>"
    flat = "<rates><generator>x</generator><date>01.03.2024</date>" + item("RUB", "5.1", 1) + "</rates>"
    got = {(r["feed_id"], r["code"]): (str(r["as_of"]), r["quant"], r["per_unit"]) for r in rate_feed.rates(spark.createDataFrame([(1, rss), (2, flat)], "feed_id int, xml string")).collect()}
    assert got == {(1, "USD"): ("2025-02-12", 1, 486.47), (1, "AMD"): ("2025-02-12", 10, 1.323), (1, "JPY"): ("2025-02-12", 100, 0.0342), (1, "Z"): ("2025-02-12", 1, 2.0), (1, "E"): ("2025-02-12", 1, 2.0), (2, "RUB"): ("2024-03-01", 1, 5.1)}


def test_catalogue(spark):
    one = json.dumps([{"service_name": "УЗИ", "synonyms": ["a", "b"], "icd": "I1"}, {"name": "КТ", "синонимы": "x;y"}], ensure_ascii=False)
    two = json.dumps({"services": [{"услуга": "МРТ", "category": "C", "id": "6f9619ff-8b86-d011-b42d-00cf4fc964ff"}]}, ensure_ascii=False)
    got = {r["service_name"]: r for r in catalogue_files.from_json(spark.createDataFrame([("1", one), ("2", two)], "path string, value string")).collect()}
    assert got["УЗИ"]["synonyms"] == ["a", "b"] and got["УЗИ"]["icd_code"] == "I1"
    assert got["КТ"]["synonyms"] == ["x", "y"] and got["МРТ"]["service_id"] and got["МРТ"]["category"] == "C"


def test_model_rows(spark):
    answer = '<think>{"rows": 1}</think>ok {"rows": [{"name": "A", "price_resident_kzt": "10 80С", "currency": "usd", "extra_tiers": [{"label": "для резидентов", "price_kzt": 5}, {"label": "СНГ", "price_kzt": 7}, {"label": "снг 2", "price_kzt": 8}, {"label": "нерезидент", "price_kzt": 9}]}, {"name": " "}]}'
    got = model_rows.rows(spark.createDataFrame([("d", answer), ("e", "none"), ("f", '[{"name": "B", "price_resident_kzt": true}]')], "doc_id string, answer string")).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["name"], r["currency"], r["resident"], r["nonresident"], r["extra_tiers"]) for r in got] == [("d", "A", "USD", 10800.0, 9.0, {"резидент": 5.0, "СНГ": 8.0}), ("f", "B", "KZT", None, None, None)]


def test_engines(spark):
    assert engines.route("docx") == "docx" and engines.route("pdf") == "geometric" and engines.route("scan_pdf") == "easyocr" and engines.route("pdf", pdf_engine="gemini") == "gemini"
    files = spark.createDataFrame([("a", bytearray(b""), 5)], "path string, content binary, pages int")
    assert [(r["chunk"], r["error"]) for r in engines.answers(files, "groq").orderBy("chunk").collect()] == [(0, "unavailable"), (1, "unavailable")]
    assert engines.corrected(["a", "b", "c"], lambda x: [y.upper() for y in x] if len(x) == 2 else [], 2) == ["A", "B", "c"]


def test_golden_and_pdf_class(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"source_file": "s", "partner": "p", "rows": [{"name": "A", "price_resident_kzt": 1}]}), encoding="utf-8")
    r = golden_files.rows(spark, str(tmp_path / "g.json")).first()
    assert (r["name"], r["currency_original"], r["expect_review"]) == ("A", "KZT", False)
    pages = spark.createDataFrame([("a", 0, "x" * 300), ("a", 1, " "), ("b", 0, "x" * 500), ("b", 6, "")], "doc_id string, page int, text string")
    assert {r["doc_id"]: r["file_format"] for r in formats.classify_pdf(pages).collect()} == {"a": "scan_pdf", "b": "pdf"}


def test_documents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "Клиника 3 2024.xlsx").write_bytes(b"1")
    (tmp_path / "x.txt").write_bytes(b"2")
    rows = formats.documents(spark, str(tmp_path)).collect()
    assert [(r["file_format"], str(r["effective_date"])) for r in rows] == [("xlsx", "2024-01-01")]
