"""Mapping of headers to fields: metadata, worked out on the driver from column names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
ALIASES = {
    "external_id": ["код", "code", "sku", "артикул", "id", "manufacturer code", "код товара"],
    "product_name": ["наименование товара", "наименование", "название товара", "название", "товар", "product name", "name", "product"],
    "description": ["описание", "description", "характеристики", "спецификация"],
    "unit": ["единица измерения", "ед изм", "ед. изм.", "единица", "unit", "uom"],
    "price": ["цена с ндс в тенге", "цена с ндс", "сметная цена тенге", "сметная цена", "цена тенге", "цена", "price", "стоимость"],
    "quantity": ["sum из кол во", "кол во", "количество", "quantity", "qty"],
    "freight_class": ["класс груза"],
    "gross_weight_kg": ["масса брутто кг", "масса брутто", "вес брутто"],
    "search_text": ["поисковый текст", "поисковая маска"],
    "category": ["категория", "category"],
    "brand": ["бренд", "brand", "производитель"],
    "model": ["модель", "model"],
    "dimensions": ["размеры", "габариты", "dimensions"],
}
HINTS = {
    "name": ["наименован", "назван", "товар", "позици", "номенклатур", "item", "name", "наим"],
    "qty": ["кол-во", "количество", "шт", "qty", "quantity", "штук", "объем", "кол во"],
    "price": ["цена", "стоимост", "price", "сумма", "тариф", "cost", "rate"],
    "code": ["код", "артикул", "article", "sku", "code", "номер"],
    "brand": ["бренд", "марка", "производитель", "brand", "manufacturer"],
    "model": ["модель", "model", "серия"],
    "specs": ["характеристик", "спецификац", "specs", "техн описан", "description"],
}


def normalize_header(header: str | None) -> str:
    text = (header or "").strip().lower().replace(" ", " ").replace("ё", "е")
    return " ".join(re.sub(r"[.,;:()\[\]«»\"' /\\-]+", " ", text).split())


def normalized_header(header: Column) -> Column:
    """``normalize_header`` of a column."""
    plain = F.replace(F.replace(F.lower(F.trim(F.coalesce(header, F.lit("")))), F.lit("\u00a0"), F.lit(" ")), F.lit("ё"), F.lit("е"))
    return F.trim(F.regexp_replace(plain, r"[.,;:()\[\]«»\"'\s/\\-]+", " "))


def _whole_words(inner: str, outer: str) -> bool:
    return bool(inner) and f" {inner} " in f" {outer} "


def map_columns(headers: list[str], overrides: dict[str, str] | None = None) -> tuple[dict[str, str], list[str]]:
    """({field: header}, headers left over): the longest alias first; one header per field, one field per header; overrides win."""
    found = []
    for field, aliases in ALIASES.items():
        for header in headers:
            h = normalize_header(header)
            found += [(-len(a), field, header) for a in aliases if _whole_words(a, h) or _whole_words(h, a)]
    mapping: dict[str, str] = {}
    for _, field, header in sorted(found, key=lambda f: f[0]):
        if field not in mapping and header not in mapping.values():
            mapping[field] = header
    mapping |= {f: h for f, h in (overrides or {}).items() if h in headers}
    return mapping, [h for h in headers if h not in mapping.values()]


def guess_columns(headers: list[str]) -> tuple[dict[str, int], bool]:
    """({field: index}, has_header): the first header with any hint; without a name column there is no header and column 0 is the name."""
    low = [(h or "").lower().strip() for h in headers]
    at = {f: next((i for i, h in enumerate(low) if any(x in h for x in hints)), -1) for f, hints in HINTS.items()}
    return (at, True) if at["name"] >= 0 else ({f: 0 if f == "name" else -1 for f in HINTS}, False)


def apply_mapping(df: DataFrame, mapping: dict[str, str], required: tuple[str, ...] = ("product_name",)) -> DataFrame:
    """Columns renamed to their fields, missing ones null; a missing required field is an error."""
    lacking = [f for f in required if f not in mapping]
    if lacking:
        raise ValueError(f"no column for {', '.join(lacking)}")
    return df.select(*[(F.col(f"`{mapping[f]}`") if f in mapping else F.lit(None).cast("string")).alias(f) for f in ALIASES])
