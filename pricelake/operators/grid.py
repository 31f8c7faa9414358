"""Price rows out of irregular grids: spreadsheets and word-processor tables.

A grid is one row per line of a sheet: ``doc_id, sheet, row_idx, cells array<string>``. Only the roles of a sheet's
columns are gathered per sheet (one row of at most as many entries as it has columns); lines stay distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import is_number_cell, parse_price
from ..functions.text import blank_to_null, clean_cell, despace

# Words that name a column's role in a header.
NAME_WORDS = ("наимен", "услуг", "обследован", "название", "перечень", "вид иссл", "манипул", "процедур")
CODE_WORDS = ("код", "шифр", "тарификат")
UNIT_WORDS = ("ед.изм", "ед. изм", "единиц", "измерения", "кол-во", "кол.во")
PRICE_WORDS = ("цена", "цены", "стоим", "тариф", "прайс", "ндс", "тенге", "руб", "тг", "kzt")
ORDINAL_WORDS = ("№", "п/п", "n п", "no")
HEADER_ROWS, PRICE_DENSITY = 60, 0.5

SHEET = ["doc_id", "sheet"]


def from_cells(cells: DataFrame) -> DataFrame:
    """Lines out of a long table ``doc_id, sheet, row_idx, col_idx, text``; gaps between columns are empty cells."""
    grouped = cells.groupBy(*SHEET, "row_idx").agg(F.map_from_entries(F.collect_list(F.struct("col_idx", "text"))).alias("m"), F.max("col_idx").alias("last"))
    return grouped.select(*SHEET, "row_idx", F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.element_at("m", i)).alias("cells"))


def has_word(header: Column, words: tuple[str, ...]) -> Column:
    """One of the words stands in the header, white space aside."""
    low, tight = F.lower(header), despace(header)
    hits = [low.contains(w) | tight.contains(w.replace(" ", "")) for w in words]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def cleaned(lines: DataFrame) -> DataFrame:
    """Cells normalised, empty lines dropped, lines numbered and padded to the sheet's width."""
    rows = lines.select(*SHEET, "row_idx", F.transform("cells", clean_cell).alias("cells")).where(F.exists("cells", lambda c: c != ""))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*SHEET).orderBy("row_idx"))).withColumn("width", F.max(F.size("cells")).over(Window.partitionBy(*SHEET)))
    return rows.withColumn("cells", F.concat("cells", F.array_repeat(F.lit(""), F.col("width") - F.size("cells"))))


def headers(lines: DataFrame) -> DataFrame:
    """(doc_id, sheet, header_nth, header): the first of the first lines that names a service and a price column, else
    the first that names a service column among two filled cells; sheets without one are left out."""
    joined = F.array_join("cells", " | ")
    near = F.col("nth") <= HEADER_ROWS
    names = near & has_word(joined, NAME_WORDS)
    sure = names & has_word(joined, PRICE_WORDS)
    maybe = names & (F.size(F.filter("cells", lambda c: c != "")) >= 2)
    found = lines.groupBy(*SHEET).agg(F.coalesce(F.min(F.when(sure, F.col("nth"))), F.min(F.when(maybe, F.col("nth")))).alias("header_nth"))
    at = found.where("header_nth is not null").withColumnRenamed("header_nth", "nth")
    return at.join(lines, [*SHEET, "nth"]).select(*SHEET, F.col("nth").alias("header_nth"), F.col("cells").alias("header"))


def column_statistics(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """Per column below the header: its header cell, the share of filled cells that are numbers, its total text."""
    data = lines.join(heads, SHEET).where("nth > header_nth").select(*SHEET, F.posexplode("cells").alias("col", "text"))
    filled = F.col("text") != ""
    stats = data.groupBy(*SHEET, "col").agg(F.coalesce(F.avg(F.when(filled, is_number_cell(F.col("text")).cast("int"))), F.lit(0.0)).alias("density"), F.sum(F.length("text")).alias("chars"))
    shown = heads.select(*SHEET, F.posexplode("header").alias("col", "label"))
    return shown.join(stats, [*SHEET, "col"], "left").fillna({"density": 0.0, "chars": 0})


def roles(stats: DataFrame) -> DataFrame:
    """(doc_id, sheet, name_col, code_col, unit_col, price_cols, price_labels). Roles go to columns from the left, a code
    before an ordinal before a name before a unit; prices need numeric data, and where no header names one, any numeric
    column without a role is one; a name that isn't named is the column with the most text."""
    flags = [has_word(F.col("label"), w).alias(n) for n, w in (("code", CODE_WORDS), ("ordinal", ORDINAL_WORDS), ("name", NAME_WORDS), ("unit", UNIT_WORDS), ("price", PRICE_WORDS))]
    sheet = stats.select(*SHEET, F.struct("col", "label", "density", "chars", *flags).alias("c")).groupBy(*SHEET).agg(F.array_sort(F.collect_list("c")).alias("cols"))

    def first(flag: str, *taken: str) -> Column:
        def fits(c):
            ok = c[flag]
            for t in taken:
                ok = ok & ~c["col"].eqNullSafe(F.col(t))
            return ok

        return F.get(F.filter("cols", fits), F.lit(0))["col"]

    for role, taken in (("code", ()), ("ordinal", ("code",)), ("name", ("code", "ordinal")), ("unit", ("code", "ordinal", "name"))):
        sheet = sheet.withColumn(f"{role}_col", first(role, *[f"{t}_col" for t in taken]))
    roleless = lambda c: ~(c["col"].eqNullSafe(F.col("code_col")) | c["col"].eqNullSafe(F.col("ordinal_col")) | c["col"].eqNullSafe(F.col("name_col")) | c["col"].eqNullSafe(F.col("unit_col")))
    dense = lambda c: c["density"] >= PRICE_DENSITY
    named = F.filter("cols", lambda c: c["price"] & ~c["unit"] & roleless(c) & dense(c))
    sheet = sheet.withColumn("prices", F.when(F.size(named) > 0, named).otherwise(F.filter("cols", lambda c: roleless(c) & dense(c))))
    texts = F.filter("cols", lambda c: roleless(c) & ~F.exists(F.col("prices"), lambda p: p["col"] == c["col"]))
    longest = F.get(F.array_sort(F.transform(texts, lambda c: F.struct((-c["chars"]).alias("k"), c["col"].alias("col")))), F.lit(0))["col"]
    sheet = sheet.withColumn("name_col", F.coalesce("name_col", longest)).where("name_col is not null")
    prices = F.filter("prices", lambda p: p["col"] != F.col("name_col"))
    return sheet.select(*SHEET, "name_col", "code_col", "unit_col", F.transform(prices, lambda p: p["col"]).alias("price_cols"), F.transform(prices, lambda p: p["label"]).alias("price_labels"))


def _cell(column: str) -> Column:
    return blank_to_null(F.get("cells", F.col(column)))


def interpret(lines: DataFrame) -> DataFrame:
    """One row per priced or named line: doc_id, sheet, row_idx, name, code, unit, section, prices, price_labels, raw.

    A line that repeats one text, or holds one cell only, and no price, is the section of the lines that follow; a line
    of small numbers (1 | 2 | 3) is skipped; a price without a name is named ``(?)``."""
    rows = cleaned(lines)
    heads = headers(rows)
    columns = roles(column_statistics(rows, heads))
    data = rows.join(heads.drop("header"), SHEET).where("nth > header_nth").join(columns, SHEET)
    filled = F.filter("cells", lambda c: c != "")
    numbering = (F.size(filled) >= 2) & F.forall(filled, lambda c: c.rlike(r"^\d{1,2}$"))
    priced = F.exists("price_cols", lambda p: is_number_cell(F.get("cells", p)))
    section = ~priced & ((F.size(F.array_distinct(filled)) == 1) | (F.size(filled) == 1))
    data = data.where(~numbering).withColumn("__section", section)
    title = F.when(F.col("__section"), F.coalesce(_cell("name_col"), F.get(filled, F.lit(0))))
    running = Window.partitionBy(*SHEET).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    data = data.withColumn("section", F.last(title, ignorenulls=True).over(running)).where(~F.col("__section"))
    prices = F.array_compact(F.transform("price_cols", lambda p: parse_price(F.get("cells", p))["value"]))
    out = data.withColumn("prices", prices).withColumn("name", _cell("name_col")).where((F.size("prices") > 0) | F.col("name").isNotNull())
    return out.select(*SHEET, "row_idx", F.coalesce("name", F.lit("(?)")).alias("name"), _cell("code_col").alias("code"), _cell("unit_col").alias("unit"), "section", "prices", "price_labels", F.array_join(F.filter("cells", lambda c: c != ""), " | ").alias("raw"))


def document_labels(rows: DataFrame) -> DataFrame:
    """The labels of the first sheet of a document that has any."""
    return rows.where(F.size("price_labels") > 0).groupBy("doc_id").agg(F.min_by("price_labels", "sheet").alias("price_labels"))
