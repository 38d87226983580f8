"""Worked values of the matching functions."""

import pytest
from pyspark.sql import functions as F

from ledgermill.functions import codes, parse, similarity, text


@pytest.fixture(scope="module")
def value(spark):
    def of(make, *given):
        row = spark.createDataFrame([given], ", ".join(f"c{i} string" for i in range(len(given))))
        return row.select(make(*[F.col(f"c{i}") for i in range(len(given))]).alias("v")).first()["v"]

    return of


def test_search_normaliser_and_tokens(value):
    assert value(text.normalize_text, "«3Д ұшбұрыш» (Интеллектум)") == "3д ұшбұрыш интеллектум"
    assert value(text.normalize_text, "Стол 900*600, 1,5 м. — ёлка №5") == "стол 900x600 1,5 м елка no5"
    assert value(text.normalize_text, None) == ""
    assert value(lambda c: text.normalize_text(c, lookalikes=True), "cop") == "сор"
    assert value(text.tokenize, "стол 900x600") == ["стол", "900x600"]
    assert value(text.tokenize, "плакаты для дошкольников 1,5") == ["плакаты", "дошкольников", "1", "5"]


def test_catalog_normaliser_and_numbers(value):
    assert value(text.clean_text, " Мяч-1, 5 PC №2 ") == "мяч 1 5 pcs no2"
    assert value(text.clean_text, "N/A") == ""
    assert value(text.clean_code, " 12345.0 ") == "12345"
    assert value(text.to_float, "1,5") == 15.0
    assert value(text.to_float, "x") is None
    assert value(text.to_number, "1 234,56 тг") == 1234.56
    assert value(text.to_number, "1,234.5") == 1234.5
    assert value(text.to_number, "not a number") is None
    assert value(text.parse_money, "1,234,5") is None
    assert value(text.parse_money, "12,5 тг") == 12.5
    assert value(lambda a, b, c: text.normalized_text(a, b, c), "Стол", None, "A-1") == "стол a 1"
    assert value(text.normalize_units, "Heater 220 Volts, 5 - kilograms!") == "heater 220v 5kg"


def test_list_functions(value):
    assert value(text.apply_aliases, "школьная парта и парта школьная") == "парта и парта школьная"
    assert value(text.fuzzy_key, "Доска интерактивная") == "интердоска"
    assert value(text.stem, "детский") == "дет"
    assert value(text.stem, "стол") == "стол"
    assert value(lambda c: text.char_ngrams(c, 2), "ab") == ["#a", "ab", "b#"]
    assert value(lambda c: text.word_ngrams(F.split(c, " ")), "a b c") == ["a", "b", "c", "a b", "b c"]
    assert value(text.parse_list_line, "[К-1] Стол x2,5").asDict() == {"name": "Стол", "qty": 2.5, "key": "стол", "code": "К-1"}
    assert value(text.clean_lines, "1. Стол\n- Стул\n\n* ") == ["Стол", "Стул"]
    assert value(text.strip_quantity, "Стол x 5") == "Стол"
    assert value(text.significant_tokens, "Грелка резиновая 2 л для детей") == ["грелка", "детей"]


def test_codes_and_attributes(value):
    assert [value(codes.category_code, c) for c in ("521-201-0501", "521-201-0709", "522-101-1090-0002", "", "521-ab-x1")] == ["521-201-0500", "521-201-0700", "522-101-1000", None, "521-ab"]
    assert [value(codes.is_category_header, c) for c in ("521-201-0500", "521-201-0501", "521-201-0000")] == [True, False, False]
    assert [value(codes.looks_like_code, c) for c in ("521-101-0420", "T6", "a-b")] == [True, False, False]
    assert value(lambda a, b: codes.dimensions(a, b), None, "Стол 80х60х75 см").asDict() == {"w": 800.0, "h": 600.0, "d": 750.0}
    assert value(lambda a: codes.dimensions(a), "полка 1,5x2").asDict() == {"w": 5.0, "h": 2.0, "d": None}
    assert value(lambda a: codes.material(a), "Шкаф из ЛДСП") == "лдсп"
    assert [value(codes.normalize_unit, u) for u in ("шт.", "к-т", "бочка", "")] == ["шт", "компл", "бочка", None]
    assert value(codes.category_from_keywords, "Рояль (170 см)") == "521-201-0500"
    assert value(codes.category_from_keywords, "Мат напольный 200x100") == "521-402-0100"
    assert [value(codes.category_from_label, x) for x in ("Мебель", "Прочее")] == ["521-208-0100", None]
    assert value(lambda a, b: codes.price_difference(a.cast("double"), b.cast("double")), "50", "100").asDict() == {"diff": 0.5, "available": 1.0}
    assert value(lambda c: codes.classify_item(c, {"A": ["стол"], "B": ["стул", "стол"], "Z": []}), "Столик") == ["A", "B"]


def test_parsers(value):
    assert value(lambda c: parse.act_line(c, True), "Стол x2, 15 000 — сломан").asDict() == {"name": "Стол", "unit": "шт.", "qty": "2", "price": "15000", "defect": "сломан"}
    got = value(parse.suppliers, 'text ```json\n[{"name":"A","rating":"9"},{"rating":"x","best":true}]\n```')
    assert [(r["name"], r["rating"], r["best"]) for r in got] == [("A", 5.0, False), ("—", 4.0, True)]
    assert value(parse.suppliers, "nothing") == []
    assert value(lambda c: parse.choice(c, 3), "Number 2 fits") == 1
    assert value(lambda c: parse.confirmations(c, 3), "1: yes\n3: no\n3: yes") == [True, False, True]
    assert value(lambda a, b, c: parse.photo_status(a, b, c), "Present", "7", None).asDict() == {"status": "found", "confidence": 1.0, "note": ""}
    assert value(parse.lenient_number, " 12,5 kg") == 12.5


def test_edit_ratios():
    assert round(similarity.token_sort_ratio("манеж детский", "манеж детский размерами 830х680 мм")) == 55
    assert similarity.token_set_ratio("манеж детский", "манеж детский размерами 830х680 мм") == 100
    assert round(similarity.token_sort_ratio("грелка резиновая", "грелка резиновая объемом 2 л")) == 73
    assert similarity.token_set_ratio("регулируемый детский стол", "стол детский регулируемый") == 100
    assert similarity.token_set_ratio("столь детский регулируемый", "стол детский регулируемый") > 90
    assert similarity.ratio("", "") == 100 and similarity.ratio("a", "") == 0
    assert similarity.ratio("lewenstein", "levenshtein") == pytest.approx(200 * 9 / 21)
    assert similarity.partial_ratio("abc", "xxabcxx") == 100
    assert 0 <= similarity.weighted_ratio("стол", "стол ученический регулируемый по высоте") <= 100


def test_set_measures(value):
    assert value(lambda a, b: similarity.name_similarity(a, b), "Стол детский", "стол детский") == 1.0
    assert value(lambda a, b: similarity.name_similarity(a, b), "", "стол") == 0.0
    assert 0 < value(lambda a, b: similarity.name_similarity(a, b), "стол детский", "стол детские") < 1
    assert value(lambda a, b: similarity.code_ratio(a, b), "A1", "A1") == 1.0
    related = lambda a, b: similarity.anchors_related(text.significant_tokens(a), text.significant_tokens(b, 12))
    assert value(related, "Грелка резиновая", "Мяч резиновый") is False
    assert value(related, "Шприцы одноразовые", "Шприц 5 мл") is True
