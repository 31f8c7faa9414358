"""Column functions on the values they are meant for."""

import random

import pytest
from pyspark.sql import functions as F

from pricelake.functions import dates, numbers, tariffs, text
from pricelake.functions.fuzzy import lcs_length, token_set_score
from pricelake.sources import formats


def values(spark, function, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("function", "cases"),
    [
        (text.normalize_name, {None: "", " Mаммография  ЁЛКИ ": "маммография елки", "B02.110 Cаниторное": "b02.110 саниторное"}),
        (text.match_key, {"УЗИ сердца": "ультразвуковое исследование сердца", "Ультразвуковое исследование сердца": "ультразвуковое исследование сердца", "эхокг": "эхокардиография", "хмэкг": "холтеровское мониторирование экг", "узист": "узист", "конс. д.м.н.": "конс. доктор медицинских наук"}),
        (text.clean_section, {"Раздел 27.Массаж": "Раздел 27. Массаж", "31.7.Определение": "31.7. Определение", "  ": None, None: None}),
        (text.code_norm, {"В 06.170.005": "B06.170.005", None: "", "сн-1": "CH1"}),
        (text.despace, {"Н аим ен овани е": "наименование"}),
        (text.valid_uuid, {"6F9619FF-8B86-D011-B42D-00CF4FC964FF": "6f9619ff-8b86-d011-b42d-00cf4fc964ff", "x": None, None: None}),
        (text.review_bucket, {"price missing or not positive": "price", "empty field": "name", "changed a lot": "change", "else": "other", None: "other"}),
        (tariffs.canonical_tier, {"страховых компаний": "страховая", "Нерезиденты": "нерезидент", "ближнее": "резидент", "для СНГ": "СНГ", "партнёрам": "партнёр", " иной ": "иной"}),
        (formats.partner_name, {"/x/Клиника 2 прайс 2025 год.PDF": "Клиника 2", "/x/Центр_здоровья-2024.xlsx": "Центр здоровья", "/x/2024.xlsx": "2024"}),
        (formats.file_format, {"/a.b/c.DOCX": "docx", "/a/b.txt": None, "/a/.pdf": None}),
        (numbers.detect_currency, {"100 $": "USD", "100 руб": "RUB", None: "KZT", "usd rub": "USD"}),
    ],
)
def test_text(spark, function, cases):
    assert values(spark, function, list(cases)) == list(cases.values())


def test_prices(spark):
    cases = {"10 800": 10800.0, "12 ООС": 12000.0, "II 000": 11000.0, "80С": 800.0, "1.234": 1234.0, "12,50": 12.5, "": None, "xyz": None, None: None, "5 000 тенге": 5000.0}
    assert values(spark, lambda c: numbers.parse_price(c, aggressive=True)["value"], list(cases)) == list(cases.values())
    clean = {"10 800": True, "12 ООС": False, None: True, "xyz": False}
    assert values(spark, lambda c: numbers.parse_price(c, aggressive=True)["clean"], list(clean)) == list(clean.values())
    cells = {"до 0,5 см": None, "1 посещение": None, "12 ООС": 12000.0, "0": None, None: None, "7 500 тг": 7500.0}
    assert values(spark, numbers.price_cell_value, list(cells)) == list(cells.values())
    whether = {"U1.1": False, "1 200 тг.": True, "": False, None: False, ".": False}
    assert values(spark, numbers.is_number_cell, list(whether)) == list(whether.values())


def test_natural_order(spark):
    names = ["10", "9", "a2", "a10", "a02b", "1" + "0" * 20, "9" * 20, "0" * 30 + "3", "", None]
    keys = values(spark, text.natural_key, names)
    number = lambda s: sorted(s, key=lambda x: keys[names.index(x)])
    assert number(["10", "9", "1" + "0" * 20, "9" * 20, "0" * 30 + "3"]) == ["0" * 30 + "3", "9", "10", "9" * 20, "1" + "0" * 20]
    assert number(["a10", "a02b", "a2"]) == ["a2", "a02b", "a10"] and keys[-1] == keys[-2] == ""


def test_dates(spark):
    cases = {"31.02.2024": None, "29.02.2024": "2024-02-29", "1.1.2024": None, None: None}
    assert [d and str(d) for d in values(spark, dates.feed_date, list(cases))] == list(cases.values())
    assert [d and str(d) for d in values(spark, formats.effective_date, ["/a/Клиника 2 прайс 2025 год.PDF", "/2030/x.pdf", "/a/1999_2001.xls"])] == ["2025-01-01", None, "2001-01-01"]


def test_synonyms_and_flags(spark):
    assert values(spark, text.parse_synonyms, ['["a", " b "]', "a; b,c", "a|b", "a, b", "one", "nan", None, "[broken"]) == [["a", "b"], ["a", "b,c"], ["a", "b"], ["a", "b"], ["one"], [], [], ["[broken"]]
    assert values(spark, text.llm_flags, ["x; LLM: odd ; LLM:", None]) == [["odd"], []]


def test_tariffs(spark):
    rows = [([1.0, 2.0, 3.0], ["СНГ", "граждан республики", "дальнее"]), ([1.0, 2.0], []), ([1.0], ["x"]), ([], []), ([5.0, 6.0, 7.0], ["a", "b"]), ([1.0, 2.0], ["нерезидент", "резидент"])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p array<double>, l array<string>")
    got = [r["t"] for r in df.select("i", tariffs.map_tariffs(F.col("p"), F.col("l")).alias("t")).orderBy("i").collect()]
    assert [(t["resident"], t["nonresident"], t["extra"]) for t in got] == [(2.0, 3.0, {"СНГ": 1.0}), (1.0, 2.0, {}), (1.0, None, {}), (None, None, {}), (5.0, 6.0, {"tier_3": 7.0}), (1.0, 2.0, {})]
    strict = df.where("i = 5").select(tariffs.map_tariffs(F.col("p"), F.col("l"), strict=True).alias("t")).first()["t"]
    assert (strict["resident"], strict["nonresident"]) == (2.0, 1.0)


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_fuzzy():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rnd.choice("абв г") for _ in range(rnd.randint(0, 20))) for _ in "ab")
        assert lcs_length(a, b) == brute_lcs(a, b)
        assert token_set_score(a, b) == pytest.approx(token_set_score(b, a))
    assert token_set_score("узи сердца", "сердца узи плода") == 100
    assert token_set_score("", "x") == 0 == token_set_score(None, "x")
    assert token_set_score("abc", "abd") == pytest.approx(100 * (1 - 2 / 6))
