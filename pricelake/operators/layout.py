"""Rows and columns out of positioned words: ``doc_id, page, x0, x1, top, text`` (and ``page_width``)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import price_cell_value
from ..functions.text import let, strip

PAGE = ["doc_id", "page"]
MIN_GAP, ROW_TOLERANCE, GAP_FLOOR, GAP_FACTOR = 6, 6.0, 7.0, 1.6
PRICE_DENSITY, BAND_NAME, BAND_PRICE = 0.6, 120, 100

# Words of units, and words that may stand between them.
UNIT_WORDS = (
    "посещение", "посещения", "прием", "приём", "приема", "приёма", "услуга", "услуги", "услуг", "год", "года", "сутки", "день", "дня", "час", "часа", "часов", "минута", "минуты", "минут",
    "исследование", "исследования", "анализ", "анализа", "операция", "операции", "процедура", "процедуры", "манипуляция", "манипуляции", "консультация", "консультации", "сеанс", "сеанса",
    "пакет", "пакета", "блок", "блока", "набор", "флакон", "ампула", "штука", "шт", "штук", "видеозвонок", "звонок", "койко", "койко-день", "кусочек", "точка", "зуб", "зуба", "снимок", "снимка",
    "проба", "пробы", "кровь", "крови", "моча", "мочи", "кал", "кала", "сыворотка", "сыв", "плазма", "плазмы", "соскоб", "мазок", "слюна", "слюны", "эякулят",
)
UNIT_LINKS = ("с", "со", "из", "у", "в", "во", "по", "и", "на", "до", "за", "о")
# What a section's first word is, and words that no section holds.
SECTION_WORDS = "раздел|блок|подраздел|глава|часть|приложение|прейскурант"
SECTION_NOISE = ("ндс", "тенге", "цена", "наимен", "единиц", "руб", "зарубежь")
# Shapes of codes.
LEADING_CODE = r"(?iu)^[A-ZА-ЯЁ]{1,5}[\d]+(?:[.\-]\d+)*$"
INLINE_CODE = r"(?u)^(?:[A-ZА-ЯЁ]{0,2}\d+(?:\.\d+)+|[A-ZА-ЯЁ]{1,2}(?:\.\d+)+|\d{4,})$"


def column_bounds(words: DataFrame, min_gap: int = MIN_GAP) -> DataFrame:
    """(doc_id, page, bounds): 0, the middles of empty vertical bands between words, the page's width. An empty band is
    where the running right edge of all words further left ends before the next word begins."""
    w = Window.partitionBy(*PAGE).orderBy("__a", "__b")
    spans = words.select(*PAGE, "page_width", F.greatest(F.lit(0), F.col("x0").cast("int")).alias("__a"), F.least(F.col("page_width").cast("int") + 1, F.col("x1").cast("int")).alias("__b"))
    edge = F.max("__b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    gaps = spans.withColumn("__edge", edge).withColumn("__mid", F.when(F.col("__a") - F.col("__edge") - 1 >= min_gap, (F.col("__edge") + 1 + F.col("__a")) / 2.0))
    return gaps.groupBy(*PAGE).agg(F.concat(F.array(F.lit(0.0)), F.array_sort(F.collect_list("__mid")), F.array(F.max("page_width").cast("double"))).alias("bounds"))


def column_of(center: Column, bounds: Column) -> Column:
    """The column a centre falls into; the first if none."""
    at = F.size(F.filter(bounds, lambda b: b <= center)) - 1
    return F.when((at >= 0) & (at < F.size(bounds) - 1), at).otherwise(0)


def visual_rows(words: DataFrame, tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """Adds ``row``: words from the top down belong to one row while they stay within the tolerance of its running
    middle. The middle depends on the path, so this is a walk over one page."""
    schema = T.StructType([*words.schema.fields, T.StructField("row", T.IntegerType())])

    def walk(page: pd.DataFrame) -> pd.DataFrame:
        page = page.assign(__top=page["top"].round(1)).sort_values(["__top", "x0"], kind="stable").drop(columns="__top")
        row, middle, numbers = -1, None, []
        for top in page["top"]:
            if middle is None or abs(top - middle) > tolerance:
                row, middle = row + 1, top
            else:
                middle = (middle + top) / 2
            numbers.append(row)
        return page.assign(row=pd.Series(numbers, index=page.index, dtype="int32"))[schema.names]

    return words.groupBy(*PAGE).applyInPandas(walk, schema)


def grid(words: DataFrame) -> DataFrame:
    """Lines of cells (``doc_id, sheet, row_idx, cells``) for :mod:`.grid`: words by visual row and column, in reading order."""
    placed = visual_rows(words).join(column_bounds(words), PAGE).withColumn("col", column_of((F.col("x0") + F.col("x1")) / 2, F.col("bounds")))
    cells = placed.groupBy(*PAGE, "row", "col", "bounds").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.bround("top").alias("t"), "x0", "text"))), lambda s: s["text"]), " ").alias("text"))
    lines = cells.groupBy(*PAGE, "row", "bounds").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("m"))
    whole = F.transform(F.sequence(F.lit(0), F.size("bounds") - 2), lambda i: F.coalesce(F.element_at("m", i), F.lit("")))
    return lines.select("doc_id", F.col("page").cast("string").alias("sheet"), F.col("row").alias("row_idx"), whole.alias("cells"))


def segments(rows: DataFrame, by: list[str], floor: float = GAP_FLOOR) -> DataFrame:
    """Adds ``cell``: a row of words breaks where a gap exceeds both the floor and a multiple of the row's upper median
    gap."""
    w = Window.partitionBy(*by).orderBy("x0", "x1")
    gaps = rows.withColumn("__gap", F.col("x0") - F.lag("x1").over(w))
    positive = F.array_sort(F.collect_list(F.when(F.col("__gap") > 0, F.col("__gap"))).over(Window.partitionBy(*by)))
    median = F.coalesce(F.get(positive, F.floor(F.size(positive) / 2).cast("int")), F.lit(0.0))
    wide = (F.col("__gap") > F.greatest(F.lit(floor), median * GAP_FACTOR)).cast("int")
    return gaps.withColumn("__wide", F.coalesce(wide, F.lit(0))).withColumn("cell", F.sum("__wide").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__gap", "__wide")


def cells(rows: DataFrame, by: list[str], floor: float = GAP_FLOOR) -> DataFrame:
    """The segments' texts: (by, cell, text, x0, x1)."""
    return segments(rows, by, floor).groupBy(*by, "cell").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda s: s["text"]), " ").alias("text"), F.min("x0").alias("x0"), F.max_by("x1", "x0").alias("x1"))


def with_wrapped_names(lines: DataFrame, by: list[str], order: str) -> DataFrame:
    """Priced lines with the unpriced lines before them put in front of their text; a section line forgets them."""
    w = Window.partitionBy(*by).orderBy(order)
    flush = (F.col("priced") | F.col("section")).cast("int")
    grouped = lines.withColumn("__flush", flush).withColumn("__group", F.coalesce(F.sum("__flush").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy(*by, "__group").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    name = F.array_join(F.collect_list("text").over(inside), " ")
    return grouped.withColumn("name", name).where("priced").drop("__flush", "__group")


def price_columns(long: DataFrame, by: list[str]) -> DataFrame:
    """(by, price_cols): the rightmost run of columns whose filled cells are mostly prices. long: by, col, text."""
    filled = F.col("text") != ""
    stats = long.groupBy(*by, "col").agg(F.coalesce(F.avg(F.when(filled, price_cell_value(F.col("text")).isNotNull().cast("int"))), F.lit(0.0)).alias("density"))
    right = Window.partitionBy(*by).orderBy(F.desc("col")).rowsBetween(Window.unboundedPreceding, 0)
    good = stats.withColumn("__good", F.col("density") >= PRICE_DENSITY).withColumn("__seen", F.max(F.col("__good").cast("int")).over(right)).withColumn("__broken", F.sum((~F.col("__good") & (F.col("__seen") == 1)).cast("int")).over(right))
    return good.where("__good and __broken = 0").groupBy(*by).agg(F.array_sort(F.collect_list("col")).alias("price_cols"))


def join_thousands(prices: Column, columns: Column, texts: Column) -> Column:
    """array<struct(col, price)>: a price of one or two digits and a next-door one of three digits are one number, cut at
    its thousands. Pairs are taken from the left."""
    items = F.transform(prices, lambda p, i: F.struct(F.get(columns, i).alias("col"), p.alias("price"), F.get(texts, i).alias("text")))
    empty = F.array().cast("array<struct<col:int,price:double,text:string>>")

    def add(done, x):
        last = F.get(done, F.size(done) - 1)
        joins = (F.size(done) > 0) & (last["col"] + 1 == x["col"]) & last["text"].rlike(r"^\s*\d{1,2}\s*$") & x["text"].rlike(r"^\s*\d{3}\s*$")
        whole = F.struct(last["col"].alias("col"), (last["price"] * 1000 + x["price"]).alias("price"), F.lit("").alias("text"))
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(whole))).otherwise(F.concat(done, F.array(x)))

    typed = F.transform(items, lambda x: F.struct(x["col"].cast("int").alias("col"), x["price"].cast("double").alias("price"), x["text"].cast("string").alias("text")))
    return F.transform(F.aggregate(typed, empty, add), lambda x: F.struct(x["col"].alias("col"), x["price"].alias("price")))


def split_row(texts: Column) -> Column:
    """struct(prices, name, unit): the trailing run of number cells is the prices, a unit cell may stand before it (not
    first), the rest is the name."""
    read = F.transform(texts, lambda t: F.struct(t.alias("text"), price_cell_value(t).alias("value")))

    def split(cells):
        last_text = F.array_max(F.transform(cells, lambda c, i: F.when(c["value"].isNull(), i)))
        return let(F.coalesce(last_text + 1, F.lit(0)), lambda cut: parts(cells, cut))

    def parts(cells, cut):
        before = F.get(cells, cut - 1)["text"]
        unit = (cut < F.size(cells)) & (cut >= 2) & looks_like_unit(before)
        return let(unit, lambda u: whole(cells, cut, before, u))

    def whole(cells, cut, before, unit):
        prices = F.transform(F.slice(cells, cut + 1, F.greatest(F.size(cells), F.lit(1))), lambda c: c["value"])
        words = F.filter(F.transform(F.slice(cells, F.lit(1), cut - F.when(unit, 1).otherwise(0)), lambda c: c["text"]), lambda t: t != "")
        return F.struct(prices.alias("prices"), strip(F.array_join(words, " ")).alias("name"), F.when(unit, before).alias("unit"))

    return let(read, split)


def looks_like_unit(text: Column) -> Column:
    """A unit of measure: at most four words, all of the vocabulary (one at least no mere link), or a count and one or
    two short words."""
    units, links = F.array(*map(F.lit, UNIT_WORDS)), F.array(*map(F.lit, UNIT_LINKS))

    def judge(low):
        tokens = F.filter(F.split(low, r"(?U)[\s/\\,;]+"), lambda t: t != "")
        return let(tokens, lambda ts: let(F.coalesce(F.get(ts, F.lit(0)).rlike(r"^\d{1,3}$"), F.lit(False)), lambda counted: fits(low, ts, counted)))

    def fits(low, tokens, counted):
        rest = F.slice(tokens, F.when(counted, 2).otherwise(1), F.greatest(F.size(tokens), F.lit(1)))
        words = F.regexp_extract_all(F.array_join(rest, " "), F.lit(r"(?U)([\p{L}]+)"), 1)
        return let(words, lambda ws: (low != "") & (F.length(low) <= 40) & F.size(ws).between(1, 4) & (vocabulary(ws) | (counted & (F.size(ws) <= 2) & F.forall(ws, lambda w: F.length(w) <= 14))))

    def vocabulary(words):
        return F.exists(words, lambda w: F.array_contains(units, w)) & F.forall(words, lambda w: F.array_contains(units, w) | F.array_contains(links, w))

    # All words of units are Cyrillic, and counts have digits: other texts need no closer look.
    may = text.rlike("(?iu)[а-яё0-9]")
    return F.when(F.coalesce(may, F.lit(False)), let(F.lower(strip(text)), judge)).otherwise(False)


def is_section(text: Column) -> Column:
    """A section's title: begins with a section word, is mostly capitals, or is a numbered short label."""
    low = F.lower(text)
    letters = F.regexp_replace(text, r"(?U)[^\p{L}]", "")
    capitals = F.regexp_replace(letters, r"(?U)[^\p{Lu}]", "")
    body = strip(F.regexp_extract(text, r"(?U)^[\s*.+•·]*\d{1,3}[.)\s]+([\p{L}].*)$", 1))
    label = (body != "") & ~body.rlike(r"(?U)^\p{Ll}") & ~body.endswith(",") & (F.size(F.split(body, r"(?U)\s+")) <= 6)
    shouted = (F.length(letters) >= 5) & (F.length(capitals) / F.length(letters) >= 0.75)
    noise = low.rlike("|".join(SECTION_NOISE))
    return F.coalesce((text != "") & (F.length(text) <= 80) & ~noise & (text.rlike(rf"(?iuU)^({SECTION_WORDS})\b") | shouted | label), F.lit(False))


def is_section_of_scan(text: Column) -> Column:
    """The looser test for scanned lines: four letters suffice and no word rules a title out."""
    letters = F.regexp_replace(text, r"(?U)[^\p{L}]", "")
    capitals = F.regexp_replace(letters, r"(?U)[^\p{Lu}]", "")
    return F.coalesce(text.rlike(rf"(?iuU)^({SECTION_WORDS})\b") | ((F.length(letters) >= 4) & (F.length(capitals) / F.length(letters) >= 0.75)), F.lit(False))


def leading_code(text: Column) -> Column:
    """struct(code, name): a leading code, else a leading row number is dropped."""

    def look(tokens):
        head = F.coalesce(F.get(tokens, F.lit(0)), F.lit(""))
        return let(head.rlike(LEADING_CODE), lambda coded: F.struct(F.when(coded, head).alias("code"), F.array_join(F.slice(tokens, F.when(coded | head.rlike(r"^\d{1,4}$"), 2).otherwise(1), F.greatest(F.size(tokens), F.lit(1))), " ").alias("name")))

    return let(F.filter(F.split(text, r"(?U)\s+"), lambda t: t != ""), look)


def code_and_name(text: Column) -> Column:
    """struct(code, name): a leading code; else, after a leading row number is dropped, the only code inside, joined with
    a one- or two-letter prefix that stands apart. Two codes inside are none."""

    def look(tokens):
        head = F.coalesce(F.get(tokens, F.lit(0)), F.lit(""))
        leading = head.rlike(LEADING_CODE)
        rest = F.slice(tokens, F.when(leading | head.rlike(r"^\d{1,4}$"), 2).otherwise(1), F.greatest(F.size(tokens), F.lit(1)))
        return let(F.struct(leading.alias("leading"), rest.alias("rest")), lambda x: inside(head, x["leading"], x["rest"]))

    def inside(head, leading, rest):
        inline = lambda t: t.rlike(INLINE_CODE) & (F.length(F.regexp_replace(t, r"\D", "")) >= 4)
        places = F.filter(F.transform(rest, lambda t, i: F.when(inline(t), i)), lambda i: i.isNotNull())
        at = let(places, lambda p: F.when(~leading & (F.size(p) == 1), F.get(p, F.lit(0))))
        return let(at, lambda i: chosen(head, leading, rest, i))

    def chosen(head, leading, rest, at):
        prefixed = F.coalesce((at >= 1) & F.get(rest, at - 1).rlike("(?u)^[A-ZА-ЯЁ]{1,2}$"), F.lit(False))
        found = F.concat(F.when(prefixed, F.get(rest, at - 1)).otherwise(F.lit("")), F.get(rest, at))
        others = F.filter(rest, lambda t, i: at.isNull() | ((i != at) & ~(prefixed & (i == at - 1))))
        return F.struct(F.when(leading, head).otherwise(found).alias("code"), F.array_join(others, " ").alias("name"))

    tokens = F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")
    # Codes and row numbers have digits.
    return F.when(~text.rlike("[0-9]"), F.struct(F.lit(None).cast("string").alias("code"), F.array_join(tokens, " ").alias("name"))).otherwise(let(tokens, look))


def is_band_artifact(prices: Column, name: Column) -> Column:
    """A whole band of lines run together before a stray small number."""
    return (F.size(prices) > 0) & (F.array_max(prices) < BAND_PRICE) & (F.length(name) > BAND_NAME)


def label_role(label: Column) -> Column:
    """F (foreign), R (resident) or U (unknown) of a header text."""
    low = F.lower(F.coalesce(label, F.lit("")))
    return (
        F.when(low.contains("нерезидент"), "F")
        .when(low.contains("резидент"), "R")
        .when(low.rlike("иностран|без граждан"), "F")
        .when(low.rlike("граждан республики|постоянно прожива|кандас|оралман"), "R")
        .when(low.rlike("зарубеж|не прожива"), "F")
        .otherwise("U")
    )


def is_confident(roles: Column) -> Column:
    """A resident's column was named, or the only one is foreign."""
    return F.array_contains(roles, "R") | ((F.size(roles) == 1) & (F.get(roles, F.lit(0)) == "F"))


def tier_pattern(roles: Column) -> Column:
    """array of resident, nonresident or extra: the first R is the resident (else the first U), the next to the right
    (else to the left) the nonresident; if all are foreign, the first is the nonresident."""
    first = lambda x: F.nullif(F.array_position(roles, x), F.lit(0)).cast("int") - 1
    single = F.size(roles) == 1
    resident = F.when(single, F.when(F.get(roles, F.lit(0)) != "F", 0)).otherwise(F.coalesce(first("R"), first("U")))
    other = F.when(resident.isNull(), 0).when(resident + 1 < F.size(roles), resident + 1).when(resident > 0, resident - 1)
    return F.transform(roles, lambda _, i: F.when(i.eqNullSafe(resident), "resident").when(i.eqNullSafe(other), "nonresident").otherwise("extra"))


def document_pattern(pages: DataFrame) -> DataFrame:
    """(doc_id, pattern) of the first page with a confident header. pages: doc_id, page, roles."""
    return pages.where(is_confident(F.col("roles"))).groupBy("doc_id").agg(F.min_by(tier_pattern(F.col("roles")), "page").alias("pattern"))


def resolve_tiers(prices: Column, columns: Column, price_columns: Column, pattern: Column) -> Column:
    """struct(resident, nonresident, extra, resolved): prices by the pattern; without one by position; where the number of
    columns differs from the pattern's, nothing is resolved and all are extra."""
    by_place = F.transform(price_columns, lambda _, i: F.when(i == 0, "resident").when(i == 1, "nonresident").otherwise("extra"))
    resolved = pattern.isNull() | (F.size(pattern) == F.size(price_columns))
    chosen = F.when(pattern.isNull(), by_place).when(resolved, pattern)
    role = lambda c: F.coalesce(F.get(chosen, F.array_position(price_columns, c).cast("int") - 1), F.lit("extra"))
    items = F.transform(prices, lambda p, i: F.struct(p.alias("p"), F.get(columns, i).alias("c"), role(F.get(columns, i)).alias("r")))
    one = lambda r: F.get(F.filter(items, lambda x: x["r"] == r), F.lit(0))["p"]
    rest = F.filter(items, lambda x: x["r"] == "extra")
    extra = F.map_from_entries(F.transform(rest, lambda x: F.struct(F.concat(F.lit("tier_"), x["c"].cast("string")).alias("key"), x["p"].alias("value"))))
    return F.struct(one("resident").alias("resident"), one("nonresident").alias("nonresident"), F.when(F.size(rest) > 0, extra).alias("extra"), resolved.alias("resolved"))
