"""Pages of words to price rows, alignment, bundles and caches, each against rows written out by hand."""

from datetime import date

import pytest
from pyspark.sql import functions as F
from test_sources import zipped
from test_store import sheet

from pricelake.operators import history, layout, pages, statistics
from pricelake.plans import ingest
from pricelake.plans.store import PriceStore
from pricelake.sources import formats, office
from pricelake.sources.rate_feed import FeedCache

WORDS = "doc_id string, page int, page_width double, x0 double, x1 double, top double, text string"


def words(doc, page, lines, step=20.0, width=700.0):
    """Lines of (x, text): the words of a text stand 2 apart, each letter is 4 wide."""
    for k, line in enumerate(lines):
        for x, text in line:
            for w in text.split(" "):
                yield doc, page, width, float(x), float(x + 4 * len(w)), step * (k + 1), w
                x += 4 * len(w) + 2


LONG = "прием врача высшей категории в день обращения"


def test_text_pages(spark):
    data = [
        *words("a", 1, [
            [(300, "цена для нерезидентов"), (450, "граждан республики"), (580, "страна снг")],
            [(10, "Раздел 1 Анализы")],
            [(40, LONG)],
            [(10, "1"), (40, LONG + " один"), (300, "2 000"), (450, "1 000"), (580, "3 000")],
            [(10, "B1.2"), (40, LONG + " два"), (300, "2 100"), (580, "3 100")],
        ]),
        *words("a", 2, [[(40, "хвост имени")], [(10, "7"), (40, LONG + " три"), (300, "2 200"), (450, "1 200"), (580, "3 300")], [(10, "8"), (40, LONG + " пять"), (300, "1"), (450, "1 200"), (580, "3 300")]]),
        *words("a", 3, [[(10, LONG + " шесть"), (300, "500"), (450, "700")], [(10, LONG + " семь"), (300, "500"), (450, "700")]]),
        *words("b", 1, [[(10, "Осмотр врача общей практики"), (200, "1 посещение"), (300, "1 500 тенге"), (400, "2 500")]]),
        *words("c", 1, [[(10, LONG + " " + LONG)], [(10, LONG), (300, "5")], [(10, "Осмотр врача общей практики"), (300, "900")]]),
    ]
    got = {(r["doc_id"], r["page"], r["row"]): r for r in pages.text_rows(spark.createDataFrame(data, WORDS)).collect()}
    row = lambda *key: [got[key][c] for c in ("name", "code", "unit", "section", "resident", "nonresident", "extra_tiers", "tariffs_resolved")]
    section = "Раздел 1 Анализы"
    assert row("a", 1, 3) == [f"{LONG} {LONG} один", None, None, section, 1000.0, 3000.0, {"tier_2": 2000.0}, True]
    assert row("a", 1, 4) == [f"{LONG} два", "B1.2", None, section, None, 3100.0, {"tier_2": 2100.0}, True]
    assert row("a", 2, 1) == [f"хвост имени {LONG} три", None, None, section, 1200.0, 3300.0, {"tier_2": 2200.0}, True]
    assert row("a", 2, 2)[4:6] == [1200.0, 3300.0]
    assert row("a", 3, 0) == [f"{LONG} шесть", None, None, section, None, None, {"tier_1": 500.0, "tier_2": 700.0}, True]  # two columns, not three
    assert row("b", 1, 0) == ["Осмотр врача общей практики", None, "1 посещение", None, 1500.0, 2500.0, None, True]  # by place
    assert got["b", 1, 0]["prices"] == [1500.0, 2500.0] and got["b", 1, 0]["currency"] == "KZT"
    assert [k for k in got if k[0] == "c"] == [("c", 1, 2)]  # the small price after a whole band of names is none, and ends the band
    assert row("c", 1, 2) == ["Осмотр врача общей практики", None, None, None, None, None, None, False] and got["c", 1, 2]["prices"] == [900.0]
    assert pages.text_rows(spark.createDataFrame([], WORDS)).count() == 0

    out = {(r["doc_id"], r["name"]): r for r in pages.serialised(pages.text_rows(spark.createDataFrame(data, WORDS)), F.array(F.lit("резидент"))).collect()}
    assert (out["b", "Осмотр врача общей практики"]["price_nonresident"], out["c", "Осмотр врача общей практики"]["price_resident"], out["c", "Осмотр врача общей практики"]["price_extra_tiers"]) == (2500.0, 900.0, None)
    assert out["a", f"{LONG} два"]["price_extra_tiers"] == {"tier_2": 2100.0} and out["a", f"{LONG} два"]["price_resident"] is None


def test_scanned_pages(spark):
    lines = [[(10, "ОАК")], [(10, "общее имя")], [(10, "12"), (60, "анализ крови"), (300, "1 посещение"), (500, "12 ООС")], [(10, "A1 проба крови из вены"), (500, "80С"), (600, "90")], [(10, "МОЧА")], [(10, "7 - - -"), (500, "5")]]
    data = [*words("a", 1, lines, 30.0), *words("a", 2, [[(10, "имя и отчество"), (500, "7")]], 30.0), ("a", 2, 700.0, 1.0, 2.0, 99.0, " "), ("a", 2, 700.0, 1.0, 2.0, 99.0, None)]
    got = [(r["page"], r["row"], r["name"], r["code"], r["section"], r["prices"]) for r in pages.scan_rows(spark.createDataFrame(data, WORDS)).orderBy("page", "row").collect()]
    assert got == [
        (1, 2, "ОАК общее имя анализ крови 1 посещение", None, None, [12000.0]),
        (1, 3, "проба крови из вены", "A1", None, [800.0, 90.0]),
        (1, 5, "- - -", None, "МОЧА", [5.0]),
        (2, 0, "имя и отчество", None, None, [7.0]),
    ]


def test_layout_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    titles = {"Раздел 2": True, "МОЧА": True, "ОАК": False, "ЦЕНА В ТЕНГЕ": True, "Осмотр": False, "": False}
    assert {t: one(layout.is_section_of_scan(F.lit(t))) for t in titles} == titles
    band = lambda prices, n: one(layout.is_band_artifact(F.array(*map(F.lit, prices)), F.lit("x" * n)))
    assert [band([99.0], 121), band([100.0], 500), band([5.0], 120), band([5.0, 200.0], 500)] == [True, False, False, False]
    tiers = lambda pattern: one(layout.resolve_tiers(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.array(*map(F.lit, (4, 5, 6))), F.array(*map(F.lit, (4, 5, 6))), F.array(*map(F.lit, pattern)) if pattern else F.lit(None).cast("array<string>")))
    assert tuple(tiers(["nonresident", "extra", "resident"])) == (3.0, 1.0, {"tier_5": 2.0}, True)
    assert tuple(tiers(None)) == (1.0, 2.0, {"tier_6": 3.0}, True) and tuple(tiers(["resident"])) == (None, None, {"tier_4": 1.0, "tier_5": 2.0, "tier_6": 3.0}, False)
    long = spark.createDataFrame([(1, c, t) for t in ("1", "2") for c, t in enumerate(["7", "имя", t, "100", ""])], "page int, col int, text string")
    assert [r["price_cols"] for r in layout.price_columns(long, ["page"]).collect()] == [[2, 3]] or layout.price_columns(long, ["page"]).first()["price_cols"] == [3]
    units = " ".join(["кровь"] * 300)
    assert not one(layout.looks_like_unit(F.lit(units))) and one(layout.code_and_name(F.lit("1 " + "слово " * 12_000)))["name"].count("слово") == 12_000


def test_alignment_is_one_to_one(spark):
    asked = [("d", 1, "x", 5.0, None), ("d", 2, "a", 1.0, 2.0), ("d", 3, "a", 1.0, None), ("d", 4, "zz", 9.0, None), ("e", 1, "a", None, None), ("f", 1, "q", 1.0, None)]
    rows = [("d", 1, "a", [1.0, 2.2]), ("d", 2, "a", [7.0, None]), ("d", 3, "b", [5.4]), ("e", 1, "a", None)]
    got = pages.aligned(spark.createDataFrame(asked, "doc_id string, golden_id int, key string, resident double, nonresident double"), spark.createDataFrame(rows, "doc_id string, row_id int, key string, prices array<double>"))
    assert sorted(tuple(r) for r in got.collect()) == [("d", 1, 3, "price", "garbled"), ("d", 2, 1, "name", "ok"), ("d", 3, 2, "name", "wrong"), ("d", 4, None, None, "missing"), ("e", 1, 1, "name", "ok"), ("f", 1, None, None, "missing")]


def test_all_rows(spark):
    """Bundles, unreadable formats, words, scans and answers meet in one table."""
    book = sheet(["Наименование услуги", "Цена, тг"], ["ОАК", "1 000"])
    files = [("/in/a.xlsx", book, "xlsx"), ("/in/b.zip", zipped({"sub/c.xlsx": book, "d.doc": b"x", "e.txt": b"x"}), "zip"), ("/in/f.zip", b"no zip", "zip"), ("/in/g.doc", b"x", "doc")]
    df = spark.createDataFrame([(p, bytearray(c), k) for p, c, k in files], "path string, content binary, file_format string")
    assert sorted((r["path"], r["file_format"]) for r in ingest.bundled(df).collect()) == [("/in/a.xlsx", "xlsx"), ("/in/b.zip/d.doc", "doc"), ("/in/b.zip/sub/c.xlsx", "xlsx"), ("/in/f.zip", "refused"), ("/in/g.doc", "doc")]
    errors = {r["doc_id"]: r["error"] for r in office.lines(ingest.bundled(df)).where("error is not null").collect()}
    assert errors.keys() == {"/in/b.zip/d.doc", "/in/g.doc"} and all("converted" in e for e in errors.values())
    text = spark.createDataFrame(list(words("w", 1, [[(10, "Осмотр врача общей практики"), (300, "1 500"), (400, "2 500")]])), WORDS)
    answers = spark.createDataFrame([("m", '{"rows": [{"name": "Проба", "price_resident_kzt": "700"}]}')], "doc_id string, answer string")
    got = ingest.all_rows(df, text, text.withColumn("doc_id", F.lit("s")), answers)
    assert sorted((r["doc_id"], r["name"], r["resident"]) for r in got.collect()) == [("/in/a.xlsx", "ОАК", 1000.0), ("/in/b.zip/sub/c.xlsx", "ОАК", 1000.0), ("m", "Проба", 700.0), ("s", "Осмотр врача общей практики", 1500.0), ("w", "Осмотр врача общей практики", 1500.0)]


def test_feed_cache():
    now, asked = [0.0], []
    cache = FeedCache(lambda day: asked.append(day) or f"feed {len(asked)}", ttl=10.0, clock=lambda: now[0])
    assert [cache.get(), cache.get(), cache.get(date(2024, 1, 1))] == ["feed 1", "feed 1", "feed 2"]
    now[0] = 10.0
    assert [cache.get(), cache.get(date(2024, 1, 1)), cache.get(refresh=True)] == ["feed 3", "feed 2", "feed 4"]

    def broken(day):
        raise OSError

    with pytest.raises(OSError):
        FeedCache(broken).get()


def test_all_documents_count(spark, tmp_path):
    store = PriceStore(spark, str(tmp_path))
    store.append("documents", spark.range(5_003).select(F.col("id").cast("string").alias("doc_id"), F.lit("done").alias("parse_status"), F.lit("p").alias("partner_id"), F.lit("2024-01-01").cast("timestamp").alias("parsed_at")))
    store._log("deleted_documents", [("7",)])
    assert store.all_documents().count() == 5_002 and store.documents(limit=9_999).count() == 5_000
    empty = spark.createDataFrame([], "service_id string, needs_review boolean")
    assert statistics.overview(store.all_documents(), empty, empty, empty).first()["documents"] == 5_002


def test_related_counts(spark):
    items = spark.createDataFrame([(1, "p", "c", "n"), (2, "p", "c", "m"), (3, "p", None, "n"), (4, "q", "c", "n"), (5, "p", None, None), (6, "p", "c", "n")], "item_id int, partner_id string, code string, name_norm string")
    pairs = history.related_pairs(items, items).groupBy("seed_id").count().collect()
    assert {tuple(r) for r in history.related_counts(items, items).collect()} == {tuple(r) for r in pairs}


def test_formats_of_members(spark):
    assert [r[0] for r in spark.createDataFrame([("a.DOCX",), ("b.doc",)], "p string").select(formats.file_format(F.col("p"))).collect()] == ["docx", None]


def test_pages_as_arrays_equal_lines_word_by_word(spark):
    import random

    rnd = random.Random(8)
    data = [("d", k // 60, 200.0, float(x := rnd.choice([0, 10, 10.5, 30, 60, 61, 120, 150])), x + rnd.choice([4.0, 9.0, 20.0]), rnd.choice([10.0, 10.04, 13.0, 14.2, 16.15, 18.5, 40.0, 60.0, 64.0]), rnd.choice(["a", "b", "č", "12", "7.5"])) for k in range(1800)]
    words = spark.createDataFrame(data, WORDS)
    rows = pages.layout.visual_rows(words, pages.TEXT_TOLERANCE)
    expected = {}
    for r in pages.layout.cells(rows, pages.LINE).orderBy(*pages.LINE, "cell").collect():
        expected.setdefault((r["page"], r["row"]), []).append(r["text"])
    lines = pages.gap_pages(pages.paged(words), pages.TEXT_TOLERANCE)
    assert {(r["page"], i): t for r in lines.collect() for i, t in enumerate(r["gap_texts"])} == expected
    plan = pages.text_rows(words)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "Join" not in plan and "Pandas" not in plan
