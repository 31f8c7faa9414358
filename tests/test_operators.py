"""Operators against sequential models of what they mean."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from pricelake.operators import golden, grid, history, layout, matching, overlay, quality, queries, rates
from pricelake.operators.versions import fold


def test_fold_equals_a_walk(spark):
    rnd = random.Random(2)
    rows = [(k, i, None if rnd.random() < 0.15 else date(2020, 1, 1) + timedelta(days=rnd.randint(0, 6)), float(rnd.randint(1, 9))) for k in range(150) for i in range(rnd.randint(1, 9))]
    got = {(r["k"], r["i"]): (r["is_active"], r["prev_resident"]) for r in fold(spark.createDataFrame(rows, "k int, i int, effective_date date, price_resident double"), ["k"], ["i"]).collect()}
    expected, current = {}, {}
    for k, i, day, price in rows:
        now = current.get(k)
        if now is None or now[1] is None or day is None or day >= now[1]:
            if now:
                expected[(k, now[0])] = (False, expected[(k, now[0])][1])
            before = now[2] if now and not (day is not None and day == now[1]) else None
            expected[(k, i)] = (True, before)
            current[k] = (i, day, price)
        else:
            expected[(k, i)] = (False, None)
    assert got == expected


def test_preview_merges_twins(spark):
    rows = [("a1", " УЗИ ", 100.0, 200.0, "c1", {}, "KZT"), ("a2", "УЗИ", 100.0, 200.0, "c2", None, "KZT"), ("a3", "УЗИ", 101.0, 200.0, "c3", {}, "KZT"), ("a4", "УЗИ", 100.0, 200.0, "c4", {}, "USD"), ("a5", "УЗИ", 100.0, 200.0, None, {"t": 1}, "KZT"), ("a6", "УЗИ", 100.0, 200.0, "c1", {}, "KZT")]
    df = spark.createDataFrame(rows, "seq string, name string, price_resident double, price_nonresident double, code string, tiers map<string,int>, currency string").withColumn("tiers", F.col("tiers").cast("map<string,decimal(14,2)>"))
    got = {r["seq"]: (r["merged_count"], r["merged_codes"]) for r in queries.merged(df).collect()}
    assert got == {"a1": (3, ["c1", "c2"]), "a3": (1, None), "a4": (1, None), "a5": (1, None)}


def test_filters_and_pages(spark):
    df = spark.createDataFrame([(1, "b", True), (2, None, True), (3, "a", False)], "i int, s string, f boolean")
    assert queries.where_given(df, s="").count() == 3
    assert queries.where_given(df, s="a").count() == 1
    assert queries.where_flag(df, "f", None).count() == 3
    assert queries.where_flag(df, "f", False).count() == 1
    assert [r["i"] for r in queries.page(df, [F.asc_nulls_last("s")], 10, 1, most=1).collect()] == [1]
    assert [r["i"] for r in df.orderBy(*queries.locale_order("s", descending=True)).collect()] == [1, 3, 2]


def test_history(spark):
    rows = [("p", date(2020, 1, 1), 10.0, 1), ("p", date(2020, 1, 1), 11.0, 2), ("p", date(2021, 1, 1), None, 3), ("p", date(2022, 1, 1), 22.0, 4)]
    pts = history.points(spark.createDataFrame(rows, "k string, effective_date date, price_resident double, seq int"), ["k"], ["seq"])
    assert [r["change_pct"] for r in history.changes(pts, ["k"]).orderBy("effective_date").collect()] == [None, None, None]
    o = history.overall(pts, ["k"]).first()
    assert (o["first_price"], o["last_price"], o["total_change_pct"], o["years"], o["points"]) == (10.0, 22.0, pytest.approx(120.0), 3, 3)


def test_reasons(spark):
    rows = [(1, None, None, None, None), (2, 100.0, 50.0, date(2030, 1, 1), 0.0), (3, 160.0, None, None, 100.0), (4, 150.0, None, None, 100.0), (5, 6e7, None, None, None)]
    df = spark.createDataFrame(rows, "i int, price_resident double, price_nonresident double, effective_date date, prev_resident double")
    got = [r["review_reason"] for r in quality.validated(df, date(2025, 1, 1)).orderBy("i").collect()]
    assert got == ["price missing or not positive", "nonresident price lower than resident; effective date is in the future", "price changed 60% vs previous version", None, "implausibly large price (suspected OCR error)"]


def test_matching(spark):
    services = spark.createDataFrame([(1, "S1", "Анализ крови", ["ОАК"], True), (2, "S2", "УЗИ сердца", ["Анализ крови", "кардио"], True), (3, "S3", "старое", [], False)], "seq int, service_id string, service_name string, synonyms array<string>, is_active boolean")
    names = ["анализ крови", "общий анализ крови", "кардио", "ультразвуковое исследование сердца плода", "нечто", "старое"]
    got = {r["name_norm"]: r for r in matching.match_all(spark.createDataFrame([(n,) for n in names], "name_norm string"), services).collect()}
    assert [(got[n]["service_id"], got[n]["match_method"]) for n in names] == [("S1", "exact"), ("S1", "synonym"), ("S2", "synonym"), ("S2", "fuzzy"), (None, None), (None, None)]
    assert got["нечто"]["match_confidence"] < 0.55


def test_upsert(spark):
    old = spark.createDataFrame([("S1", "УЗИ", ["a"], None, "i1")], "service_id string, service_name string, synonyms array<string>, category string, icd_code string")
    new = spark.createDataFrame([(1, None, " узи ", ["b", "a"], "C", "i2"), (2, "N", "Новая", None, None, None), (3, None, "  ", [], "x", None)], "seq int, service_id string, service_name string, synonyms array<string>, category string, icd_code string")
    got = {r["service_name"]: r for r in matching.upsert(old, new).collect()}
    assert got.keys() == {"УЗИ", "Новая"}
    assert (got["УЗИ"]["synonyms"], got["УЗИ"]["category"], got["УЗИ"]["icd_code"], got["УЗИ"]["is_new"]) == (["a", "b"], "C", "i1", False)
    assert (got["Новая"]["service_id"], got["Новая"]["is_new"]) == ("N", True)


def test_overlays(spark):
    items = spark.createDataFrame([("i1", "S", "exact", 1.0, None, "n", "x; LLM: a", True, False), ("i2", None, None, None, None, "m", None, False, False)], "item_id string, service_id string, match_method string, match_confidence double, verification_note string, name string, review_reason string, needs_review boolean, is_verified boolean")
    events = spark.createDataFrame([("i1", 1, "T", "why"), ("i1", 2, None, ""), ("i2", 1, "T", None)], "item_id string, seq int, service_id string, note string")
    got = {r["item_id"]: (r["service_id"], r["match_method"], r["verification_note"]) for r in overlay.with_matches(items, events).collect()}
    assert got == {"i1": (None, None, "why"), "i2": ("T", "manual", None)}
    edits = spark.createDataFrame([("i1", 1, "name", "a"), ("i1", 2, "name", None)], "item_id string, seq int, field string, value string")
    assert {r["item_id"]: r["name"] for r in overlay.with_edits(items, edits, ["name"]).collect()} == {"i1": None, "i2": "m"}
    clean = overlay.recleaned(items, spark.createDataFrame([("i2", ["new"])], "item_id string, flags array<string>"))
    assert {r["item_id"]: (r["review_reason"], r["needs_review"]) for r in clean.collect()} == {"i1": ("x", True), "i2": ("LLM: new", True)}


def test_rates(spark):
    feed = spark.createDataFrame([(date(2024, 1, 5), "USD", 450.0)], "as_of date, code string, per_unit double").withColumn("per_unit", F.col("per_unit").cast("decimal(12,6)"))
    wanted = spark.createDataFrame([(date(2024, 1, 5), "USD"), (date(2024, 1, 6), "USD"), (date(2024, 1, 5), "EUR")], "as_of date, code string")
    got = {(r["as_of"].day, r["code"]): (r["per_unit"] and float(r["per_unit"]), r["source"]) for r in rates.with_fallback(spark, feed, wanted).collect()}
    assert got == {(5, "USD"): (450.0, "nbk"), (6, "USD"): (486.47, "last_good"), (5, "EUR"): (None, None)}


def sheet(*rows):
    return [("d", "s", i, list(r)) for i, r in enumerate(rows)]


def test_grid(spark):
    rows = sheet(["", "Прайс"], ["№", "Н аим ен ование услуги", "Код", "Цена, тг", "Для нерезидентов, тенге"], ["1", "2", "3", "4", "5"], ["Раздел A"] * 5, ["1", "УЗИ", "B02.1", "1 200", ""], ["2", "", "", "500", "700"], ["3", "Анализ", "C1", "0", "9"])
    got = grid.interpret(spark.createDataFrame(rows, "doc_id string, sheet string, row_idx int, cells array<string>")).orderBy("row_idx").collect()
    assert [(r["name"], r["code"], r["section"], r["prices"]) for r in got] == [("УЗИ", "B02.1", "Раздел A", [1200.0]), ("(?)", None, "Раздел A", [500.0, 700.0]), ("Анализ", "C1", "Раздел A", [0.0, 9.0])]
    assert got[0]["price_labels"] == ["Цена, тг", "Для нерезидентов, тенге"]


def profile(items, width, gap):
    cover = [0] * (int(width) + 2)
    for a, b in items:
        for x in range(max(0, int(a)), min(len(cover) - 1, int(b)) + 1):
            cover[x] += 1
    out, x = [0.0], 0
    while x < len(cover):
        y = x
        while y < len(cover) and not cover[y]:
            y += 1
        if y > x and x > 0 and y < len(cover) - 1 and y - x >= gap:
            out.append((x + y) / 2)
        x = max(y, x + 1)
    return [*out, float(width)]


def test_column_bounds_equal_a_pixel_profile(spark):
    rnd = random.Random(3)
    pages = {p: [(a := rnd.uniform(0, 280), a + rnd.uniform(1, 40)) for _ in range(rnd.randint(1, 7))] for p in range(80)}
    words = spark.createDataFrame([("d", p, a, b, 0.0, "w", 330.0) for p, items in pages.items() for a, b in items], "doc_id string, page int, x0 double, x1 double, top double, text string, page_width double")
    got = {r["page"]: r["bounds"] for r in layout.column_bounds(words).collect()}
    assert got == {p: profile(items, 330.0, 6) for p, items in pages.items()}


def test_layout_pieces(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    code = lambda t: tuple(one(layout.code_and_name(F.lit(t))))
    assert code("В02.110.002 Осмотр") == ("В02.110.002", "Осмотр") or code("В02.110.002 Осмотр")[1] == "Осмотр"
    assert code("12 Осмотр В 06.170.005 врача") == ("В06.170.005", "Осмотр врача")
    assert code("Осмотр 1151 и 10401") == (None, "Осмотр 1151 и 10401")
    units = {"1 посещение": True, "кровь с ЭДТА": False, "с из": False, "сеанс": True, "3 кабинета": True, "Осмотр врача хирурга": False, "": False}
    assert {u: one(layout.looks_like_unit(F.lit(u))) for u in units} == units
    sections = {"Раздел 1": True, "ГЕМАТОЛОГИЯ": True, "9 Гинекология": True, "12.1 Хирургия": False, "ЦЕНА УСЛУГ": False, "лекарственных средств": False}
    assert {t: one(layout.is_section(F.lit(t))) for t in sections} == sections
    s = one(layout.split_row(F.array(*map(F.lit, ["УЗИ", "1 посещение", "1 200", "2 400"]))))
    assert (s["prices"], s["name"], s["unit"]) == ([1200.0, 2400.0], "УЗИ", "1 посещение")
    joined = one(layout.join_thousands(F.array(F.lit(22.0), F.lit(200.0), F.lit(900.0)), F.array(F.lit(3), F.lit(4), F.lit(5)), F.array(F.lit("22"), F.lit("200"), F.lit("900"))))
    assert [(x["col"], x["price"]) for x in joined] == [(3, 22200.0), (5, 900.0)]
    pattern = {("R", "F"): ["resident", "nonresident"], ("F",): ["nonresident"], ("F", "R"): ["nonresident", "resident"], ("F", "F"): ["nonresident", "extra"], ("U", "R", "F"): ["extra", "resident", "nonresident"]}
    assert {k: one(layout.tier_pattern(F.array(*map(F.lit, k)))) for k in pattern} == pattern
    assert [one(layout.label_role(F.lit(t))) for t in ("Нерезидент", "резидент рк", "дальнее зарубежье", "цена")] == ["F", "R", "F", "U"]


def test_visual_rows(spark):
    words = spark.createDataFrame([("d", 1, 10.0, 20.0, 100.0, "a"), ("d", 1, 30.0, 40.0, 104.0, "b"), ("d", 1, 10.0, 20.0, 107.5, "c"), ("d", 1, 10.0, 20.0, 130.0, "e")], "doc_id string, page int, x0 double, x1 double, top double, text string")
    assert {r["text"]: r["row"] for r in layout.visual_rows(words).collect()} == {"a": 0, "b": 0, "c": 0, "e": 1}


def test_golden_alignment():
    assert golden.align([("a", 1.0), ("b", 2.0), ("a", 3.0)], [("a", [9.0]), ("x", [2.3]), ("y", [3.0])]) == [0, 1, 2]


def test_golden_comparison_equals_all_pairs_without_making_them(spark):
    rnd = random.Random(5)
    pick = lambda *x: rnd.choice(x)
    price = lambda: pick(None, 1.0, 2.0, 2.25, 3.0, 7.5)
    asked = [(i, pick(None, "a", "b", "c", "d"), pick(None, "", "x", "y", "z"), price(), pick(None, 5.0), pick("KZT", "RUB")) for i in range(150)]
    parsed = [(f"r{i:02}", pick(None, "a", "a", "b"), pick(None, "", "x", "y"), price(), pick(None, 5.0, 6.0), pick("KZT", "RUB"), pick(None, {"t": 5.25}), pick(None, True, False)) for i in range(12)]
    expected = {}
    for i, key, code, resident, foreign, currency in asked:
        found = [p for p in parsed if key is not None and p[1] == key] or [p for p in parsed if code and p[2] == code]
        far = lambda p, r=resident: 1e18 if p[3] is None or r is None else abs(p[3] - r)
        best = min(found, key=lambda p, c=code: (c is None or p[2] != c, far(p), p[0]), default=None)
        if best is None:
            expected[i] = ("missing", False)
            continue
        near = best[3] is None if resident is None else best[3] is not None and abs(best[3] - resident) <= 0.5
        held = foreign is None or any(abs(x - foreign) <= 0.5 for x in [*(best[6] or {}).values(), best[4]] if x is not None)
        expected[i] = ("wrong_currency" if currency != best[5] else "wrong_resident" if not near else "ok" if held else "wrong_foreign", bool(best[7]))
    golden_rows = spark.createDataFrame(asked, "golden_id int, key string, code_key string, resident double, nonresident double, currency string")
    parsed_rows = spark.createDataFrame(parsed, "row_id string, key string, code_key string, resident double, nonresident double, currency string, tiers map<string,double>, needs_review boolean")
    got = golden.compare(golden_rows, parsed_rows)
    assert {r["golden_id"]: (r["verdict"], r["flagged"]) for r in got.collect()} == expected
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_fuzzy_compares_all_at_every_size(spark, monkeypatch):
    import random

    from pricelake.functions.fuzzy import Choices, token_set_score

    monkeypatch.setattr(matching, "BROADCAST_CHOICES", 1, raising=False)  # the former switch
    monkeypatch.setattr(matching, "BLOCK_CHOICES", 2, raising=False)
    services = spark.createDataFrame([(1, "S1", "ультросонография", ["узи"], True), (2, "S2", "анализ крови", ["оак"], True), (3, "S3", "рентген", [], True)], "seq int, service_id string, service_name string, synonyms array<string>, is_active boolean")
    got = {r["name_norm"]: r for r in matching.match_all(spark.createDataFrame([("ультрасонография",), ("рентгин",), ("ж",), ("анализ мочи",)], "name_norm string"), services).collect()}
    assert (got["ультрасонография"]["service_id"], got["ультрасонография"]["match_confidence"]) == ("S1", 0.9375)
    assert (got["рентгин"]["service_id"], got["рентгин"]["match_method"]) == ("S3", "fuzzy") and got["ж"]["match_confidence"] == 0
    assert got["анализ мочи"]["suggestion_id"] == "S2"
    rnd = random.Random(3)
    names = [" ".join("".join(rnd.choice("abc") for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(0, 4))) for _ in range(300)]
    choices = Choices(names[:200])
    for key in names[100:] + [None]:
        scores = [token_set_score(key, c) for c in names[:200]]
        assert choices.best(key) == (scores.index(max(scores)), max(scores))
