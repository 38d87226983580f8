"""Text functions as Column expressions.

Each matching pipeline has its own normaliser and its own tokens; they differ on
purpose and are never mixed.  All are built-in expressions except ``nfkc``.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters and word lists that results depend on.
QUOTES = {"«": '"', "»": '"', "“": '"', "”": '"', "„": '"', "‘": "'", "’": "'", "‹": "'", "›": "'"}
HYPHENS = "‐‑‒–—―−"
LOOKALIKES = ("aceopxykmthb", "асеорхукмтнв")
KAZAKH = "әғқңөұүһі"
STOPWORDS = (
    "для и в с со на из по от до или а к о об при под над за не the "
    "шт штук штука мм см м кг г л мл компл уп пач "
    "және үшін мен бен пен"
).split()
MISSING = ("", "nan", "none", "n/a", "-", "<na>", "nat")
WEAK_NAME_TOKENS = (
    "резиновый резиновая резиновое резиновые одноразовые одноразовый одноразовая напольный напольная настольный настольная "
    "пластиковый пластиковая металлический металлическая деревянный деревянная электрический электрическая "
    "медицинский медицинская медицинские профессиональный профессиональная многофункциональный многофункциональная "
    "размер размеры мм см метр метра"
).split()
NAME_STOPWORDS = "для и в на по из с со к от до при без или не шт комплект набор тип модель the and for with".split()
UNIT_WORDS = [
    (r"\bmillimeters?\b", "mm"), (r"\bmillimetres?\b", "mm"), (r"\bcentimeters?\b", "cm"), (r"\bcentimetres?\b", "cm"),
    (r"\bmeters?\b", "m"), (r"\bmetres?\b", "m"), (r"\bkilograms?\b", "kg"), (r"\bgrams?\b", "g"), (r"\bliters?\b", "l"), (r"\blitres?\b", "l"),
    (r"\bmilliliters?\b", "ml"), (r"\bmillilitres?\b", "ml"), (r"\bwatts?\b", "w"), (r"\bvolts?\b", "v"), (r"\bamperes?\b", "a"), (r"\bamps?\b", "a"),
    (r"\bhertz\b", "hz"), (r"\binches?\b", "in"),
]
LIST_UNITS = [
    (r"sht\.?", "sht"), (r"шт\.?", "шт"), ("штук", "шт"), ("штуки", "шт"), (r"кг\.?", "кг"), ("кило", "кг"), ("килограмм", "кг"), (r"г\.?", "г"), ("грамм", "г"),
    (r"м\.?", "м"), ("метр", "м"), ("метров", "м"), (r"см\.?", "см"), ("сантиметр", "см"), (r"мм\.?", "мм"), ("миллиметр", "мм"), (r"л\.?", "л"), ("литр", "л"),
    (r"компл\.?", "компл"), ("комплект", "компл"), (r"упак\.?", "упак"), ("упаковк", "упак"), (r"рул\.?", "рул"), ("рулон", "рул"),
    (r"\bpcs?\.?\b", "pcs"), (r"\bpc\.?\b", "pcs"), (r"\bkg\.?\b", "kg"), (r"\bcm\.?\b", "cm"), (r"\bmm\.?\b", "mm"), (r"\bm\.?\b", "m"),
]
SYNONYMS = [
    (["интерактивная доска", "доска интерактивная", "умная доска", "смарт доска", "смарт-доска", "интерактивные доски", "доски интерактивные"], "интердоска"),
    (["документ-камера", "документ камера", "визуализатор", "докум камера", "документ-камеры"], "докками"),
    (["школьная парта", "парта школьная", "парты школьные", "школьные парты", "парта ученическая", "ученическая парта", "парты ученические", "ученический стол", "стол ученический", "столы ученические"], "парта"),
    (["ученический стул", "стул ученический", "стулья ученические", "ученические стулья", "стул для учеников", "стулья для учеников", "стулья для класса", "стул для класса"], "стул учен"),
    (["мультимедийный проектор", "проектор мультимедийный", "мультимедиа проектор"], "проектор"),
    (["компьютер моноблок", "моноблок компьютер", "персональный компьютер"], "моноблок"),
    (["акустическая система", "акустические системы", "колонки активные", "активные колонки", "акустика активная"], "акустика"),
    (["учительский стол", "стол учителя", "стол педагога", "рабочий стол учителя"], "стол учителя"),
    (["шкаф для одежды", "шкаф гардеробный", "гардеробный шкаф", "шкаф для учеников", "шкаф ученический", "шкафы для одежды"], "шкаф гардероб"),
    (["интерактивная панель", "панель интерактивная", "тач-панель", "сенсорная панель"], "интерпанель"),
]
SUFFIXES = (
    "ского ской ских ским ские ская ский ного ной ных ным ними ние ные ная ный "
    "ого ому его ему ыми ыме ые ый ых ым ими ие ии ий их им ью ая ое ям ах"
).split()


@F.arrow_udf(StringType())
def nfkc(values: pa.Array) -> pa.Array:
    """Unicode NFKC, which Spark has no expression for; Arrow batches, ASCII values pass."""
    return pa.array([None if v is None else v if v.isascii() else unicodedata.normalize("NFKC", v) for v in values.to_pylist()], pa.string())


def _text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def _collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _all(c: Column, rules) -> Column:
    for pattern, value in rules:
        c = F.regexp_replace(c, "(?U)" + pattern, value)
    return c


# --- search normaliser and tokens --------------------------------------------------


def normalize_text(c: Column | str, lookalikes: bool = False, unicode: bool = True) -> Column:
    """Lower case, ё as е, plain quotes and hyphens, ``x`` between dimensions, no punctuation but inside numbers."""
    t = F.lower(nfkc(_text(c)) if unicode else _text(c))
    t = F.translate(t, "ё" + "".join(QUOTES) + HYPHENS, "е" + "".join(QUOTES.values()) + "-" * len(HYPHENS))
    t = F.regexp_replace(t, r"(\d)\s*[xх×*]\s*(?=\d)", "$1x")
    t = F.regexp_replace(t, r"""[«»"'`()\[\]{}<>;:!?/\\|*_+№#%&@~^]+""", " ")
    t = F.regexp_replace(t, r"(?<!\d)[.,]|[.,](?!\d)", " ")
    t = F.replace(t, F.lit("-"), F.lit(" "))
    return _collapse(F.translate(t, *LOOKALIKES) if lookalikes else t)


def tokenize(c: Column | str, drop_stopwords: bool = True) -> Column:
    """Letters (Latin, Cyrillic, Kazakh) and digits in order, repeats kept, stopwords left out."""
    found = F.regexp_extract_all(F.lower(_text(c)), F.lit(rf"[a-zа-я{KAZAKH}0-9]+"), F.lit(0))
    return F.filter(found, lambda x: ~x.isin(STOPWORDS)) if drop_stopwords else found


def normalized_name(name: Column | str, description: Column | str | None = None) -> Column:
    """Of the name only: descriptions are left out on purpose, they make sides less alike."""
    return normalize_text(name)


# --- catalog normaliser --------------------------------------------------------------


def is_missing(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | F.lower(F.trim(c.cast("string"))).isin(*MISSING)


def clean_text(c: Column | str, unicode: bool = True) -> Column:
    """Latin, Russian letters and digits only (Kazakh letters and hyphens go); ``pc`` and ``pcs`` are ``pcs``."""
    t = F.when(is_missing(c), "").otherwise(F.trim(_text(c)))
    t = F.lower(nfkc(t) if unicode else t)
    return F.regexp_replace(_collapse(F.regexp_replace(t, r"(?U)[^a-z0-9а-яё\s]", " ")), r"(?U)\bpcs?\b", "pcs")


def clean_code(c: Column | str) -> Column:
    """Upper case; a trailing ``.0`` of an integral number goes."""
    return F.when(is_missing(c), "").otherwise(F.regexp_replace(F.upper(F.trim(_text(c))), r"^(\d+)\.0$", "$1"))


def to_float(c: Column | str) -> Column:
    """Commas and blanks are dropped, so ``1,5`` is 15."""
    return F.when(~is_missing(c), F.nanvl(F.regexp_replace(_text(c), "[, ]", "").try_cast("double"), F.lit(None).cast("double")))


def to_number(c: Column | str) -> Column:
    """With both separators the comma groups thousands, else it is the decimal sign."""
    kept = F.regexp_replace(_text(c), r"[^\d,.\-]", "")
    both = F.contains(kept, F.lit(",")) & F.contains(kept, F.lit("."))
    return F.when(both, F.replace(kept, F.lit(","), F.lit(""))).otherwise(F.replace(kept, F.lit(","), F.lit("."))).try_cast("double")


def parse_money(c: Column | str) -> Column:
    """Only the first comma becomes a point; what is no number then is null."""
    kept = F.regexp_replace(_text(c), r"[^\d.,-]", "")
    at = F.instr(kept, ",")
    return F.when(at > 0, F.overlay(kept, F.lit("."), at, F.lit(1))).otherwise(kept).try_cast("double")


def normalized_text(*parts: Column | str) -> Column:
    """Cleaned parts that are not empty, joined by a blank."""
    return F.concat_ws(" ", *[F.nullif(clean_text(p), F.lit("")) for p in parts])


def search_text(*parts: Column | str) -> Column:
    """Non-empty parts joined by a blank."""
    return F.trim(F.concat_ws(" ", *[F.nullif(_text(p), F.lit("")) for p in parts]))


def item_search_text(name: Column | str, description: Column | str) -> Column:
    """Search text of a request."""
    return search_text(name, description)


def catalog_search_text(name: Column | str, brand: Column | str, model: Column | str, description: Column | str, specs: Column | str) -> Column:
    """Search text of a catalog row."""
    return search_text(name, brand, model, description, specs)


def embedding_text(name: Column | str, brand: Column | str, model: Column | str, description: Column | str, specs: Column | str, code: Column | str) -> Column:
    """What of a product is embedded."""
    return search_text(name, brand, model, description, specs, code)


def normalize_units(c: Column | str) -> Column:
    """Unit words to abbreviations, no gap between number and unit, no punctuation but points."""
    t = F.when(F.lower(F.trim(_text(c))).isin("nan", "none"), "").otherwise(F.lower(_text(c)))
    t = F.regexp_replace(_all(t, UNIT_WORDS), r"(?U)(\d+(?:\.\d+)?)\s*[-]?\s*(mm|cm|m|kg|g|ml|l|w|v|a|hz|in)\b", "$1$2")
    return _collapse(F.regexp_replace(t, r"(?U)[^\w\s.]", " "))


# --- list comparison -----------------------------------------------------------------


def clean_list_text(c: Column | str) -> Column:
    """Like ``clean_text``, with unit words replaced one after the other, inside words too."""
    t = F.lower(nfkc(F.trim(_text(c))))
    return _collapse(_all(_collapse(F.regexp_replace(t, r"(?U)[^a-z0-9а-яё\s]", " ")), LIST_UNITS))


def item_key(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(clean_list_text(c), r"[.,;:]+$", ""))


def apply_aliases(c: Column) -> Column:
    """Of each synonym group, in order, the first variant found is replaced throughout."""
    groups = F.array(*[F.struct(F.array(*[F.lit(v) for v in variants]).alias("variants"), F.lit(name).alias("name")) for variants, name in SYNONYMS])

    def replaced(t: Column, g: Column) -> Column:
        chosen = F.get(F.filter(g["variants"], lambda v: F.contains(t, v)), F.lit(0))
        return F.when(chosen.isNull(), t).otherwise(F.replace(t, chosen, g["name"]))

    return F.aggregate(groups, c, replaced)


def words_of(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda x: x != "")


def fuzzy_key(c: Column | str) -> Column:
    return F.array_join(F.array_sort(words_of(apply_aliases(item_key(c)))), " ")


def stem(word: Column) -> Column:
    """The first suffix of the list that leaves three letters goes; words under five letters stay."""
    cases = [F.when(F.endswith(word, F.lit(s)) & (F.length(word) - len(s) >= 3), F.substring(word, F.lit(1), F.length(word) - len(s))) for s in SUFFIXES]
    return F.when(F.length(word) < 5, word).otherwise(F.coalesce(*cases, word))


def char_ngrams(c: Column, n: int) -> Column:
    """Set of character n-grams of the text padded by ``#``."""
    def grams(padded: Column) -> Column:
        last = F.length(padded) - n + 1
        made = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(padded, i, F.lit(n))))
        return F.when(last < 1, F.array().cast("array<string>")).otherwise(made)

    # bound to a variable, so that the text is worked out once
    return F.get(F.transform(F.array(F.concat(F.lit("#" * (n - 1)), c, F.lit("#" * (n - 1)))), grams), F.lit(0))


def word_ngrams(tokens: Column) -> Column:
    """Set of the words and the pairs of neighbours."""
    pairs = F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(tokens, F.when(F.size(tokens) > 1, pairs).otherwise(F.array().cast("array<string>"))))


def parse_list_line(c: Column | str) -> Column:
    """``[CODE] name x5`` as struct(name, qty, key, code)."""
    raw = F.trim(_text(c))
    code = F.nullif(F.trim(F.regexp_extract(raw, r"^\[([^\]]+)\]\s*", 1)), F.lit(""))
    rest = F.regexp_replace(raw, r"^\[[^\]]+\]\s*", "")
    sized = r"(?i)^(.*?)(?:\s*[xх]\s*(\d+(?:[.,]\d+)?))\s*$"
    has = rest.rlike(sized)
    name = F.trim(F.when(has, F.regexp_extract(rest, sized, 1)).otherwise(rest))
    qty = F.when(has, F.replace(F.regexp_extract(rest, sized, 2), F.lit(","), F.lit(".")).cast("double"))
    return F.struct(name.alias("name"), qty.alias("qty"), item_key(name).alias("key"), code.alias("code"))


# --- further token classes ---------------------------------------------------------


def token_set(c: Column | str) -> Column:
    """Set of Latin and Russian words and numbers of two characters or more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(_text(c)), F.lit("[a-zа-яё0-9]+"), F.lit(0)), lambda x: F.length(x) > 1))


def latin_tokens(c: Column | str) -> Column:
    """Set of Latin words and numbers; other scripts yield none."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_text(c)), F.lit("[a-z0-9]+"), F.lit(0)))


def significant_tokens(c: Column | str, limit: int = 6) -> Column:
    """The first ``limit`` words of a name that are no filler, weak adjective, number or under three letters."""
    found = F.transform(F.regexp_extract_all(_text(c), F.lit("[a-zA-Zа-яА-ЯёЁ0-9]+"), F.lit(0)), F.lower)
    return F.slice(F.filter(found, lambda x: ~x.isin(NAME_STOPWORDS + WEAK_NAME_TOKENS) & ~x.rlike(r"^\d+$") & (F.length(x) >= 3)), 1, limit)


def clean_lines(c: Column | str, most: int = 40) -> Column:
    """Lines without bullets and numbering; the first ``most`` that are not empty."""
    lines = F.transform(F.split(_text(c), r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"^[\s\-*•\d.)]+", "")))
    return F.slice(F.filter(lines, lambda x: x != ""), 1, most)


def strip_quantity(c: Column | str) -> Column:
    """A trailing ``x 5`` goes."""
    return F.trim(F.regexp_replace(_text(c), r"(?i)\s*[xх×]\s*\d+(?:[.,]\d+)?\s*$", ""))
