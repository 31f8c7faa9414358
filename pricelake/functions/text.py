"""Text functions: ``Column -> Column``, whole-stage friendly, without Python workers.

White space is Unicode white space throughout (``(?U)``), as a name may hold no-break spaces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARK = "\u0001"
_SPACES = r"(?U)\s+"

# Latin letters and the Cyrillic ones that look alike.
LATIN_LOOKALIKES = "ABEKMHOPCTYXaeopcyxkmht"
CYRILLIC_LOOKALIKES = "АВЕКМНОРСТУХаеорсухкмнт"

# Abbreviations and their full forms.
ABBREVIATIONS = {
    "узи": "ультразвуковое исследование",
    "уздг": "ультразвуковая допплерография",
    "уздс": "ультразвуковое дуплексное сканирование",
    "кт": "компьютерная томография",
    "ркт": "рентгеновская компьютерная томография",
    "мрт": "магнитно-резонансная томография",
    "мскт": "мультиспиральная компьютерная томография",
    "рг": "рентгенография",
    "ро": "рентгенография",
    "ркг": "рентгенография",
    "экг": "электрокардиография",
    "ээг": "электроэнцефалография",
    "эхо": "эхокардиография",
    "эхокг": "эхокардиография",
    "эхо-кг": "эхокардиография",
    "эхокс": "эхокардиоскопия",
    "ктг": "кардиотокография",
    "рэг": "реоэнцефалография",
    "эмг": "электромиография",
    "энмг": "электронейромиография",
    "фвд": "функция внешнего дыхания",
    "фгдс": "фиброгастродуоденоскопия",
    "эгдс": "эзофагогастродуоденоскопия",
    "фгс": "фиброгастроскопия",
    "ффа": "флюоресцентная ангиография",
    "цдк": "цветовое допплеровское картирование",
    "смад": "суточное мониторирование артериального давления",
    "хм": "холтеровское мониторирование",
    "хмэкг": "холтеровское мониторирование экг",
    "холтер": "суточное мониторирование экг",
    "флг": "флюорография",
    "фг": "флюорография",
    "оак": "общий анализ крови",
    "оам": "общий анализ мочи",
    "бак": "биохимический анализ крови",
    "бх": "биохимия",
    "соэ": "скорость оседания эритроцитов",
    "срб": "с-реактивный белок",
    "пцр": "полимеразная цепная реакция",
    "ифа": "иммуноферментный анализ",
    "охс": "общий холестерин",
    "лпнп": "липопротеины низкой плотности",
    "лпвп": "липопротеины высокой плотности",
    "ттг": "тиреотропный гормон",
    "пса": "простатический специфический антиген",
    "рв": "реакция вассермана",
    "rw": "реакция вассермана",
    "вич": "вирус иммунодефицита человека",
    "hbs": "поверхностный антиген гепатита b",
    "гсг": "гистеросальпингография",
    "ат-тпо": "антитела к тиреопероксидазе",
    "афп": "альфа-фетопротеин",
    "ктт": "коагулограмма",
    "д.м.н.": "доктор медицинских наук",
    "к.м.н.": "кандидат медицинских наук",
    "дмн": "доктор медицинских наук",
    "кмн": "кандидат медицинских наук",
    "лор": "оториноларинголог",
    "воп": "врач общей практики",
    "узд": "ультразвуковая диагностика",
    "ад": "артериальное давление",
    "чсс": "частота сердечных сокращений",
    "цнс": "центральная нервная система",
    "жкт": "желудочно-кишечный тракт",
    "лфк": "лечебная физкультура",
    "эко": "экстракорпоральное оплодотворение",
    "в/в": "внутривенно",
    "в/м": "внутримышечно",
    "п/к": "подкожно",
}


# Review queues and what their reasons hold, in the order they are tried.
REVIEW_BUCKETS = {
    "price": "цен|price|резидент|resident|nonresident|implausible|тариф",
    "name": "наименован|назван|name|пуст|empty",
    "change": "измен|change|%|previous|верси",
}


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at either end (Spark's trim knows spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_cell(c: Column) -> Column:
    """A grid cell: null is empty, white space runs are one space, ends are trimmed."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), _SPACES, " "))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def fold_homoglyphs(c: Column) -> Column:
    """Latin look-alikes become Cyrillic in words that hold a Cyrillic letter; white space stays as it is."""
    parts = F.split(F.regexp_replace(c, r"(?U)(\s+)", f"{_MARK}$1{_MARK}"), _MARK)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("(?iu)[а-яё]"), F.translate(p, LATIN_LOOKALIKES, CYRILLIC_LOOKALIKES)).otherwise(p)), "")


def normalize_name(c: Column) -> Column:
    """Lower case, ё as е, look-alikes folded, white space collapsed; null is empty."""
    return clean_cell(fold_homoglyphs(F.translate(F.lower(F.coalesce(c, F.lit(""))), "ё", "е")))


def _escaped(word: str) -> str:
    return "".join(f"\\{ch}" if not ch.isalnum() else ch for ch in word)


def expand_abbreviations(c: Column) -> Column:
    """Whole-word abbreviations become their full forms, in one pass and not again inside them.

    Matches are fenced off by marks, the pieces between odd marks are looked up, and all are joined again."""
    longest_first = sorted(ABBREVIATIONS, key=len, reverse=True)
    inside = r"[а-яёa-z0-9]"
    fenced = F.regexp_replace(c, f"(?<!{inside})({'|'.join(map(_escaped, longest_first))})(?!{inside})", f"{_MARK}$1{_MARK}")
    full = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    pieces = F.transform(F.split(fenced, _MARK), lambda p, i: F.when(i % 2 == 1, F.coalesce(F.element_at(full, p), p)).otherwise(p))
    return F.when(fenced.contains(_MARK), F.array_join(pieces, "")).otherwise(c)


def match_key(c: Column) -> Column:
    """The key of matching, search and versioning. Not idempotent: never apply it to a key."""
    return expand_abbreviations(normalize_name(c))


def despace(c: Column) -> Column:
    """All white space gone, lower case: for headers whose letters were spread out."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), _SPACES, "")


def clean_section(c: Column) -> Column:
    """A space after a dot that abuts a word; white space collapsed; blank is null."""
    spaced = F.regexp_replace(c, r"(?U)\.(?=\S)(?=\D)", ". ")
    return F.when(c == "", c).otherwise(blank_to_null(clean_cell(spaced))) if c is not None else c


def code_norm(c: Column) -> Column:
    """Codes in Latin capitals, digits and dots only; Cyrillic look-alikes folded."""
    return F.regexp_replace(F.upper(F.translate(F.coalesce(c, F.lit("")), CYRILLIC_LOOKALIKES, LATIN_LOOKALIKES)), "[^A-Z0-9.]", "")


def parse_synonyms(c: Column) -> Column:
    """Synonyms from a cell: a JSON list, else split at the first of ``;`` ``|`` ``,`` it holds, else one; blanks go."""
    text = strip(F.coalesce(c, F.lit("")))
    listed = F.from_json(text, "array<string>")
    parts = F.when(text.startswith("[") & listed.isNotNull(), listed)
    for separator in (";", "|", ","):
        parts = parts.when(text.contains(separator), F.split(text, f"[{separator}]"))
    stripped = F.transform(parts.otherwise(F.array(text)), strip)
    found = F.filter(stripped, lambda x: x.isNotNull() & (x != "") & (F.lower(x) != "nan"))
    return F.coalesce(found, F.array().cast("array<string>"))


def valid_uuid(c: Column) -> Column:
    """The identifier in lower case if it is a UUID, else null."""
    low = F.lower(strip(c))
    return F.when(low.rlike("^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$"), low)


def reasons_text(reasons: Column) -> Column:
    """Reasons joined by ``; ``, null without any."""
    return blank_to_null(F.array_join(F.array_compact(reasons), "; "))


def llm_flags(reason: Column) -> Column:
    """What stands after ``LLM:`` in the parts of a reason."""
    parts = F.transform(F.split(F.coalesce(reason, F.lit("")), ";"), strip)
    flags = F.transform(F.filter(parts, lambda p: p.startswith("LLM:")), lambda p: strip(F.substring(p, F.lit(5), F.length(p))))
    return F.filter(flags, lambda p: p != "")


def without_llm_flags(reason: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(reason, F.lit("")), ";"), strip)
    return F.filter(parts, lambda p: (p != "") & ~p.startswith("LLM:"))


def review_bucket(reason: Column) -> Column:
    """The queue a review reason belongs to: price, name, change or other, by the first that fits."""
    text = F.coalesce(reason, F.lit(""))
    found = F
    for bucket, pattern in REVIEW_BUCKETS.items():
        found = found.when(text.rlike(f"(?iu){pattern}"), bucket)
    return found.otherwise("other")


def contains_folded(query: str, *columns: Column) -> Column:
    """Case-insensitive substring over several fields joined; nulls are empty."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns])).contains(query.strip().lower())


def ilike_any(c: Column, query: str) -> Column:
    """ILIKE ``%query%``: ``%`` and ``_`` inside the query are wildcards."""
    return c.ilike(f"%{query}%")


def natural_key(c: Column) -> Column:
    """A sort key in which digit runs of any length compare as numbers: each, without its leading zeros, follows its length."""
    fenced = F.regexp_replace(F.coalesce(c, F.lit("")), r"(\d+)", f"{_MARK}$1{_MARK}")
    number = lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda d: F.concat(F.lpad(F.length(d).cast("string"), 10, "0"), d))
    return F.array_join(F.transform(F.split(fenced, _MARK), lambda p, i: F.when(i % 2 == 1, number(p)).otherwise(p)), "")


def money_text(c: Column) -> Column:
    """``12 345 ₸``; a dash for null."""
    return F.coalesce(F.concat(F.translate(F.format_number(c, 0), ",", " "), F.lit(" ₸")), F.lit("—"))


def date_text(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "dd.MM.yyyy"), F.lit("—"))


def percent_text(c: Column) -> Column:
    return F.coalesce(F.concat(F.format_number(c, 1), F.lit("%")), F.lit("—"))
