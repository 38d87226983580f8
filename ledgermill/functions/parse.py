"""Parsers of free text lines and of model replies, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermill.functions.text import _text

FOUND = ("found", "найдено", "present", "yes")
ABSENT = ("missing", "нет", "absent", "no", "not_found")
SUPPLIER = "array<struct<name:string,loc:string,price:string,lead:string,moq:string,rating:string,best:boolean,src:string,url:string>>"


def lenient_number(c: Column | str) -> Column:
    """The leading number, comma as decimal sign, blanks dropped; 0 if there is none."""
    t = F.replace(F.regexp_replace(_text(c), r"\s+", ""), F.lit(","), F.lit("."))
    return F.coalesce(F.regexp_extract(t, r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", 0).try_cast("double"), F.lit(0.0))


def act_line(c: Column | str, has_defect: bool = False, has_price: bool = True) -> Column:
    """struct(name, unit, qty, price, defect) of a line like ``Desk x2, 15 000 — broken``; null for a blank line."""
    raw = F.trim(_text(c))
    line, defect = raw, F.lit("")
    if has_defect:
        cut = r"(?s)^(.+?)\s+[—-]\s+(.+)$"
        defect = F.trim(F.regexp_extract(raw, cut, 2))
        line = F.when(raw.rlike(cut), F.trim(F.regexp_extract(raw, cut, 1))).otherwise(raw)
    price = F.lit("")
    if has_price:
        cut = r"(?:,|;|\s-\s|\s—\s)\s*([\d\s]{2,}(?:[.,]\d{1,2})?)\s*$"
        price = F.replace(F.regexp_replace(F.regexp_extract(line, cut, 1), r"\s+", ""), F.lit(","), F.lit("."))
        line = F.trim(F.regexp_replace(line, cut, ""))
    cut = r"(?i)[xх]\s*(\d+(?:[.,]\d+)?)\s*$"
    qty = F.replace(F.regexp_extract(line, cut, 1), F.lit(","), F.lit("."))
    line = F.trim(F.regexp_replace(F.trim(F.regexp_replace(line, cut, "")), r"[,;]\s*$", ""))
    name = F.when(line != "", line).otherwise(raw)
    return F.when(raw != "", F.struct(name.alias("name"), F.lit("шт.").alias("unit"), qty.alias("qty"), price.alias("price"), defect.alias("defect")))


def json_array(c: Column | str, schema: str) -> Column:
    """The array of a reply: fences dropped, from the first ``[`` to the last ``]``; an empty array if there is none."""
    t = F.trim(_text(c))
    fenced = F.regexp_extract(t, r"(?is)```(?:json)?\s*(.*?)```", 1)
    body = F.regexp_extract(F.when(fenced != "", fenced).otherwise(t), r"(?s)\[.*\]", 0)
    return F.coalesce(F.from_json(F.nullif(body, F.lit("")), schema), F.array().cast(schema))


def suppliers(c: Column | str, most: int | None = None) -> Column:
    """Supplier rows of a reply with defaults, bounds and at least one marked best."""

    def cut(field: Column, default: str, n: int) -> Column:
        return F.left(F.coalesce(F.nullif(field, F.lit("")), F.lit(default)), F.lit(n))

    rows = json_array(c, SUPPLIER)
    rows = rows if most is None else F.slice(rows, 1, most)
    none_best = ~F.exists(rows, lambda x: F.coalesce(x["best"], F.lit(False)))
    return F.transform(
        rows,
        lambda x, i: F.struct(
            cut(x["name"], "—", 120).alias("name"),
            cut(x["loc"], "—", 120).alias("loc"),
            cut(x["price"], "Цена по запросу", 80).alias("price"),
            cut(x["lead"], "—", 80).alias("lead"),
            cut(x["moq"], "—", 80).alias("moq"),
            F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.coalesce(x["rating"].try_cast("double"), F.lit(4.0)))).alias("rating"),
            (F.coalesce(x["best"], F.lit(False)) | (none_best & (i == 0))).alias("best"),
            cut(x["src"], "web", 80).alias("src"),
            F.left(F.coalesce(x["url"], F.lit("")), F.lit(500)).alias("url"),
        ),
    )


def photo_status(status: Column, confidence: Column, note: Column) -> Column:
    """struct(status, confidence, note): status folded to found, missing or unclear."""
    s = F.lower(F.coalesce(status, F.lit("unclear")))
    folded = F.when(s.isin(*FOUND), "found").when(s.isin(*ABSENT), "missing").otherwise("unclear")
    sure = F.coalesce(confidence.try_cast("double"), F.when(folded == "unclear", 0.4).otherwise(0.6))
    return F.struct(folded.alias("status"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), sure)).alias("confidence"), F.left(F.coalesce(note, F.lit("")), F.lit(240)).alias("note"))


def choice(c: Column | str, n: int) -> Column:
    """The number from 1 to n that a reply names first, as an index from 0; null for none."""
    k = F.regexp_extract(_text(c), r"\d+", 0).try_cast("int")
    return F.when((k >= 1) & (k <= n), k - 1)


def confirmations(c: Column | str, n: int) -> Column:
    """n booleans of a reply with lines like ``2: yes``; unnamed ones are false, a later line wins."""
    lines = F.transform(F.split(_text(c), r"\r?\n"), lambda x: F.struct(F.regexp_extract(x, r"^\s*(\d+)", 1).try_cast("int").alias("k"), F.lower(x).rlike(r"\b(yes|да|true)\b").alias("v")))
    last = lambda i: F.get(F.reverse(F.filter(lines, lambda x: x["k"] == i)), F.lit(0))
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.coalesce(last(i)["v"], F.lit(False)))


def json_vector(c: Column | str) -> Column:
    """A vector from its JSON text; null if it is no array of numbers."""
    made = F.from_json(F.trim(_text(c)), "array<double>")
    return F.when(F.exists(made, lambda x: x.isNull()), None).otherwise(made)


def json_safe(row: Column) -> Column:
    """A record (struct or map) as JSON text; values without a JSON form are written as strings."""
    return F.to_json(row)
