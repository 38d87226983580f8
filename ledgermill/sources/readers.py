"""Tables with spreadsheet headers to canonical rows, one reader per kind of file.

Headers are metadata and are resolved on the driver; rows are Column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.functions.codes import category_code
from ledgermill.functions.text import clean_code, is_missing, normalized_text, to_float
from ledgermill.operators.statistics import numbered

# Headers in lower case that stand for a field, the first one found counts.
CATALOG_HEADERS = {
    "code": ["government code", "gov code", "code", "government_code", "код", "код тру", "гос код"],
    "name": ["product name", "name", "product_name", "наименование товара", "наименование", "название", "название товара"],
    "brand": ["brand", "manufacturer", "бренд", "производитель"],
    "model": ["model", "model number", "model_number", "модель"],
    "description": ["description", "desc", "описание"],
    "technical_specs": ["technical specifications", "technical specs", "specs", "specifications", "технические характеристики", "технические спецификации", "характеристики"],
    "price": ["price", "unit price", "cost", "цена", "цена с ндс, в тенге", "цена с ндс", "цена, тенге", "стоимость"],
    "category": ["category", "product category", "category_name", "категория", "раздел", "группа", "классификатор"],
    "category_code": ["category code", "category_code", "код категории", "код раздела"],
}
ITEM_HEADERS = {
    "item_code": ["item code", "item_code", "code", "код"],
    "item_name": ["item name", "item_name", "name", "наименование товара", "наименование", "название"],
    "description": ["description", "desc", "описание"],
    "quantity": ["quantity", "qty", "количество", "кол-во"],
    "category": ["category", "product category", "category_name", "категория", "раздел", "группа"],
    "category_code": ["category code", "category_code", "код категории", "код раздела"],
}
GOVERNMENT_COLUMNS = {"canonical_code": "Government Code", "name": "Product Name", "brand": "Brand", "model": "Model", "description": "Description", "specs": "Technical Specifications", "price": "Price"}
OUR_COLUMNS = {"item_code": "Item Code", "item_name": "Item Name", "description": "Description", "quantity": "Quantity"}
NEED_COLUMNS = ("Наименование", "Код", "Категория", "Описание", "Ед.изм.", "Кол-во")
LIST_COLUMNS = {
    "Код": ["Код"],
    "Наименование": ["Наименование"],
    "Описание": ["Описание"],
    "Единица измерения": ["Единица измерения"],
    "Сметная цена, тенге": ["Сметная цена, тенге", "Сметная цена", "Цена, тенге", "Сметная цена, тг"],
    "поисковый текст": ["поисковый текст"],
}


def resolve_headers(headers: list[str], aliases: dict[str, list[str]]) -> dict[str, str]:
    """{field: header} by exact aliases, without regard to case and outer blanks; of equal headers the last one counts."""
    known = {h.strip().lower(): h for h in headers}
    return {field: known[hit] for field, names in aliases.items() if (hit := next((n for n in names if n in known), None)) is not None}


def aliases_of_source(mappings: DataFrame, source_id: int, defaults: dict[str, list[str]] = CATALOG_HEADERS) -> dict[str, list[str]]:
    """Aliases that a source's mappings (source_id, field_key, excel_header) give, with the missing default ones behind."""
    own = mappings.where(F.col("source_id") == source_id).select("field_key", "excel_header").collect()  # the header row of one file
    found: dict[str, list[str]] = {}
    for r in own:
        found.setdefault(r["field_key"], []).append(r["excel_header"].strip().lower())
    return {field: found.get(field, []) + [a for a in defaults.get(field, []) if a not in found.get(field, [])] for field in {**found, **defaults}}


def _required(lacking: list[str], headers: list[str]) -> None:
    if lacking:
        raise ValueError(f"required columns missing: {lacking}; found: {headers}")


def _at(mapping: dict[str, str], field: str) -> Column:
    return F.col("`" + mapping[field].replace("`", "``") + "`").cast("string") if field in mapping else F.lit(None).cast("string")


def _string(c: Column) -> Column:
    return F.when(~is_missing(c), F.trim(c))


def read_catalog(df: DataFrame, aliases: dict[str, list[str]] | None = None, custom: tuple[str, ...] = ()) -> DataFrame:
    """Canonical catalog rows; rows without a name are dropped; the section follows from the code where none is given."""
    m = resolve_headers(df.columns, aliases or CATALOG_HEADERS)
    _required([f for f in ("name",) if f not in m], df.columns)
    at = lambda f: _at(m, f)
    code = clean_code(at("code"))
    fields = [F.struct(F.lit(k).alias("key"), _string(at(k)).alias("value")) for k in custom]
    extra = F.map_from_entries(F.filter(F.array(*fields), lambda e: e["value"].isNotNull())) if custom else F.create_map().cast("map<string,string>")
    return df.where(~is_missing(at("name"))).select(
        code.alias("code"),
        *[_string(at(f)).alias(f) for f in ("name", "brand", "model", "description", "technical_specs")],
        to_float(at("price")).alias("price"),
        F.coalesce(_string(at("category_code")), category_code(code)).alias("category_code"),
        _string(at("category")).alias("category_name"),
        normalized_text(code, at("name"), at("brand"), at("model"), at("description"), at("technical_specs")).alias("normalized_text"),
        extra.alias("custom_fields"),
    )


def read_items(df: DataFrame) -> DataFrame:
    """Canonical request rows; rows without a name are dropped."""
    m = resolve_headers(df.columns, ITEM_HEADERS)
    _required([f for f in ("item_name",) if f not in m], df.columns)
    at = lambda f: _at(m, f)
    code = clean_code(at("item_code"))
    return df.where(~is_missing(at("item_name"))).select(
        code.alias("item_code"),
        F.trim(at("item_name")).alias("item_name"),
        _string(at("description")).alias("description"),
        to_float(at("quantity")).alias("quantity"),
        _string(at("category_code")).alias("category_code"),
        _string(at("category")).alias("category_name"),
        normalized_text(code, at("item_name"), at("description")).alias("normalized_text"),
    )


def read_fixed(df: DataFrame, columns: dict[str, str], required: tuple[str, ...], trimmed: tuple[str, ...] = ()) -> DataFrame:
    """Fields by fixed headers; a missing required one is an error, a missing optional one is empty, as are nulls."""
    _required([columns[f] for f in required if columns[f] not in df.columns], df.columns)
    there = {f: h for f, h in columns.items() if h in df.columns}
    value = lambda f: F.coalesce(_at(there, f), F.lit(""))
    return df.select(*[(F.trim(value(f)) if f in trimmed else value(f)).alias(f) for f in columns])


def read_government_catalog(df: DataFrame, columns: dict[str, str] = GOVERNMENT_COLUMNS) -> DataFrame:
    return read_fixed(df, columns, ("canonical_code", "name", "description"), ("canonical_code",))


def read_our_items(df: DataFrame, columns: dict[str, str] = OUR_COLUMNS) -> DataFrame:
    return read_fixed(df, columns, tuple(columns), ("item_code",))


def collapsed_header(header: str) -> str:
    """White space collapsed, nothing else."""
    return " ".join(header.split())


def read_needs(df: DataFrame, order: str = "source_row") -> DataFrame:
    """Rows with a name, numbered from 1 in order of a numeric column, with their text."""
    named = df.toDF(*[collapsed_header(c) for c in df.columns])
    _required([c for c in NEED_COLUMNS if c not in named.columns], named.columns)
    rows = named.where(F.coalesce(F.trim("`Наименование`"), F.lit("")) != "")
    text = F.concat(F.col("`Наименование`"), F.lit(" "), F.coalesce("`Описание`", F.lit("")))
    return numbered(rows.withColumn("need_text", text), order, (order,), "need_index")


def read_price_list(df: DataFrame) -> DataFrame:
    """Rows with a name under their canonical headers, price as a number or null, with their text."""
    named = df.toDF(*[collapsed_header(c) for c in df.columns])
    found = {base: next((c for c in names if c in named.columns), None) for base, names in LIST_COLUMNS.items()}
    _required([base for base, c in found.items() if c is None], named.columns)
    rows = named.select(*[F.col(f"`{c}`").alias(base) for base, c in found.items()]).where("`Наименование` is not null")
    text = F.concat_ws(" ", "`Наименование`", F.coalesce("`Описание`", F.lit("")), F.coalesce("`поисковый текст`", F.lit("")))
    return rows.withColumns({"catalog_text": text, "Сметная цена, тенге": F.col("`Сметная цена, тенге`").try_cast("double")})


def master_records(records: DataFrame, upload_id: int | str, include_inactive: bool = False) -> DataFrame:
    """The records of an upload; inactive ones only on demand."""
    own = records.where(F.col("upload_id") == upload_id)
    return own if include_inactive else own.where(F.coalesce("active", F.lit(True)))
