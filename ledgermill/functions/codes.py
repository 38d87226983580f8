"""Catalog codes, categories, attributes and money differences as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermill.functions.text import _text, clean_list_text, normalize_text

# Fixed values.
MATERIALS = [
    ("лдсп", "лдсп"), ("дсп", "дсп"), ("мдф", "мдф"), ("фанер", "фанера"), ("дерев", "дерево"), ("нержавею", "нержавеющая сталь"), ("металл", "металл"),
    ("сталь", "сталь"), ("пластик", "пластик"), ("поролон", "поролон"), ("резин", "резина"), ("текстил", "текстиль"), ("ткан", "ткань"), ("стекл", "стекло"), ("кож", "кожа"),
]
UNITS = {
    "шт": "шт", "штук": "шт", "штука": "шт", "компл": "компл", "комплект": "компл", "к т": "компл", "набор": "компл", "уп": "уп", "упаковка": "уп", "пач": "пач", "пачка": "пач",
    "пог м": "пог_м", "погонный метр": "пог_м", "кв м": "м2", "м2": "м2", "м": "м", "метр": "м", "кг": "кг", "г": "г", "л": "л", "мл": "мл",
}
CATEGORY_HINTS = {
    "521-201-0500": ["рояль", "пианино", "фортепиано", "гитар", "скрипк", "виолончел", "флейт", "саксофон", "барабан", "музыкальн", "укулеле", "струнн", "смычков", "клавиш", "орган", "аккордеон", "баян", "синтезатор", "труба", "тромбон", "кларнет", "корнет"],
    "521-105-0500": ["домбр", "кобыз", "жетіген", "jetigen", "саз", "канон", "национальн музык"],
    "521-402-0100": ["физкульт", "гимнаст", "лечебн", "тренаж", "гантел", "штанг", "гриф", "мат напольн", "мат борцов", "батут", "скакалк", "обруч", "мяч гимнаст"],
    "521-301-0300": ["математ", "геометр", "штангенциркул", "циркуль", "транспортир"],
    "521-101-0100": ["игров", "кукольн", "манеж", "песочниц", "горк"],
    "522-103-0100": ["стол", "стул", "шкаф", "стеллаж", "тумб"],
    "521-208-0100": ["мебель", "изо", "ателье", "табурет", "стул", "культ", "трудов"],
    "521-102-0100": ["изо", "рисован", "краск", "кист", "мольберт", "холст"],
}
CATEGORY_LABELS = {
    "521-208-0100": ["мебель", "изо", "ателье", "интерьер", "диван", "кресл", "стул", "шкаф"],
    "522-103-0100": ["мебель", "стол", "стеллаж", "тумб"],
    "521-101-0400": ["техника", "компьютер", "оргтехника", "it", "пк", "моноблок", "мфу", "принтер"],
    "522-101-0200": ["электро", "лаборатор", "питани"],
}
NO_LABEL = ("", "прочее", "другое", "other", "разное")
REST = "Прочее"


def _parts(code: Column | str) -> Column:
    return F.filter(F.split(F.trim(_text(code)), "-"), lambda p: p != "")


def category_code(code: Column | str) -> Column:
    """``521-201-0501`` is of section ``521-201-0500``; the third part keeps its width."""
    p = _parts(code)
    third = F.get(p, F.lit(2))
    section = F.lpad((F.floor(third.try_cast("bigint") / 100) * 100).cast("string"), F.length(third), F.lit("0"))
    first_two = F.concat_ws("-", F.get(p, F.lit(0)), F.get(p, F.lit(1)))
    return F.when(F.size(p) < 2, None).when((F.size(p) < 3) | ~third.rlike(r"^\d+$"), first_two).otherwise(F.concat_ws("-", first_two, section))


def is_category_header(code: Column | str) -> Column:
    p = _parts(code)
    third = F.get(p, F.lit(2))
    return F.coalesce((F.size(p) >= 3) & third.rlike(r"^\d*00$") & ~third.isin("000", "0000"), F.lit(False))


def looks_like_code(code: Column | str) -> Column:
    p = _parts(code)
    return (F.size(p) >= 2) & F.exists(p, lambda x: x.rlike(r"^\d+$"))


_DIMENSIONS = r"(\d+(?:\.\d+)?)x(\d+(?:\.\d+)?)(?:x(\d+(?:\.\d+)?))?"


def dimensions(*texts: Column | str) -> Column:
    """struct(w, h, d) in millimetres from the first text with ``NxN`` or ``NxNxN``; a next word ``см`` means centimetres."""

    def of(c):
        t = normalize_text(c)
        found = F.regexp_extract(t, _DIMENSIONS, 0)
        after = F.regexp_extract(t, _DIMENSIONS + r"(.{0,6})", 4)
        scale = F.when(F.split(F.trim(after), " ")[0] == "см", 10.0).otherwise(1.0)
        part = lambda g: F.round(F.regexp_extract(t, _DIMENSIONS, g).try_cast("double") * scale, 2)
        return F.when(found != "", F.struct(part(1).alias("w"), part(2).alias("h"), part(3).alias("d")))

    return F.coalesce(*[of(c) for c in texts])


def material(*texts: Column | str) -> Column:
    """The first stem of the list in the first text that has one."""

    def of(c):
        t = normalize_text(c)
        return F.coalesce(*[F.when(F.contains(t, F.lit(s)), F.lit(name)) for s, name in MATERIALS])

    return F.coalesce(*[of(c) for c in texts])


def normalize_unit(c: Column | str) -> Column:
    t = F.nullif(normalize_text(c), F.lit(""))
    known = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, t), t)


def attributes(name, description, raw_dimensions, unit) -> Column:
    return F.struct(dimensions(raw_dimensions, name, description).alias("dims"), material(name, description).alias("material"), normalize_unit(unit).alias("unit"))


def category_from_keywords(text: Column) -> Column:
    """The section with most hint words in the text; of equal ones the first of the list."""
    t = F.lower(text)
    votes = [F.struct(sum((F.contains(t, F.lit(h)).cast("int") for h in hints), F.lit(0)).alias("n"), F.lit(-k).alias("order"), F.lit(code).alias("code")) for k, (code, hints) in enumerate(CATEGORY_HINTS.items())]
    best = F.array_max(F.array(*votes))
    return F.when(best["n"] > 0, best["code"])


def contains_any(t: Column, words: list[str]) -> Column:
    return reduce(or_, [F.contains(t, F.lit(w)) for w in words])


def category_from_label(label: Column) -> Column:
    t = F.lower(F.trim(_text(label)))
    found = [F.when(contains_any(t, labels), F.lit(code)) for code, labels in CATEGORY_LABELS.items()]
    return F.when(~t.isin(*NO_LABEL), F.coalesce(*found))


def classify_item(name: Column | str, vocabulary: dict[str, list[str]]) -> Column:
    """All classes with a keyword in the cleaned name, in order of the vocabulary; ``Прочее`` if none."""

    def classes(t: Column) -> Column:
        hits = [F.when(contains_any(t, words), F.lit(c)) for c, words in vocabulary.items() if words]
        found = F.array_compact(F.array(*hits))
        return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(REST)))

    # bound to a variable, so that the name is cleaned once
    return F.get(F.transform(F.array(clean_list_text(name)), classes), F.lit(0))


def price_difference(a: Column, b: Column) -> Column:
    """struct(diff, available): |a - b| / max(a, b); (1, 0) if one is missing or not positive."""
    ok = F.coalesce((a > 0) & (b > 0), F.lit(False))
    return F.struct(F.when(ok, F.abs(a - b) / F.greatest(a, b)).otherwise(1.0).alias("diff"), F.when(ok, 1.0).otherwise(0.0).alias("available"))


def saturate(raw: Column, at: float = 6.0) -> Column:
    return F.when(raw > 0, 1 - F.exp(-raw / F.lit(at))).otherwise(0.0)
