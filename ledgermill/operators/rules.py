"""Rule filters and rankers over candidate rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.functions.codes import looks_like_code
from ledgermill.functions.similarity import anchors_related, code_ratio, feature_similarity, fuzzy_name_udf, jaccard, name_features, ratio_udf
from ledgermill.functions.text import clean_list_text, latin_tokens, significant_tokens
from ledgermill.operators import bounded
from ledgermill.sources.store import stored

# Fixed values.
MEDICAL_WORDS = [
    "шприц", "грелк", "жгут", "катетер", "бинт", "шина", "стетоскоп", "тонометр", "небулайзер", "ингалятор", "физиотерап", "дарсонвал", "гальваниза",
    "магнитотерап", "ультразвук", "электрофорез", "аппарат для", "медицин", "кислородн", "перчатк мед", "маска мед", "халат",
]
MEDICAL_NAMES = (
    "шприц шприцы грелка грелки жгут жгуты катетер катетеры бинт бинты шина шины стетоскоп тонометр небулайзер ингалятор кислородный "
    "перчатки шприцов игла иглы канюля система венозный внутривенный"
).split()
#: Least ratio of an item's text and a section's name.
PARTIAL_RATIO = 72.0
NON_MEDICAL_SECTIONS = ["522-101-1000", "521-402-0100", "521-301-0300", "521-301-0500", "521-301-1600", "521-202-0600"]


def filter_candidates(rows: DataFrame, floor: float = 0.35, by_category: bool = True) -> DataFrame:
    """Candidates (qid, id, score, note, code_matched, item_code, code, item_category, category, blocked) after the code, category and floor rules.

    The floor spares only rows that came with a code match, not those matched here.
    """
    both = (F.coalesce("item_code", F.lit("")) != "") & (F.coalesce("code", F.lit("")) != "")
    exact = both & (F.col("item_code") == F.col("code"))
    rows = rows.withColumn("__sim", F.when(both & ~exact & looks_like_code("item_code"), ratio_udf("item_code", "code") / 100))
    near = F.coalesce(F.col("__sim") > 0.8, F.lit(False))
    score = F.when(exact, F.greatest("score", F.lit(0.95))).when(near, F.greatest("score", F.least(F.lit(0.9), F.col("score") + 0.2))).otherwise(F.col("score"))
    note = F.concat("note", F.when(exact, "; exact code match").when(near, F.format_string("; similar code (%.2f)", "__sim")).otherwise(""))
    out = rows.withColumns({"__new": score, "note": note, "__matched": F.col("code_matched") | exact | near})
    other = F.coalesce(F.col("category") != F.col("item_category"), F.lit(False)) & F.lit(by_category)
    kept = out.where((~other | F.col("__matched")) & (~F.coalesce("blocked", F.lit(False)) | F.col("__matched")) & ((F.col("__new") >= floor) | F.col("code_matched")))
    return kept.withColumns({"score": F.col("__new"), "code_matched": F.col("__matched")}).drop("__new", "__sim", "__matched")


def filter_list_candidates(rows: DataFrame, floor: float = 0.32, ratio: str | None = None) -> DataFrame:
    """The list tool's rules on (qid, id, score, item_code, code): codes compared by character pairs, a match spares the floor.

    A column ``ratio`` may hold the codes' ratio already, trimmed and in upper case.
    """
    a, b = F.upper(F.trim(F.coalesce("item_code", F.lit("")))), F.upper(F.trim(F.coalesce("code", F.lit(""))))
    both = (a != "") & (b != "")
    exact, near = both & (a == b), both & ((F.col(ratio) if ratio else code_ratio(a, b)) > 0.8)
    score = F.when(exact, F.greatest("score", F.lit(0.95))).when(near, F.greatest("score", F.least(F.lit(0.9), F.col("score") + 0.2))).otherwise(F.col("score"))
    return rows.withColumns({"score": score, "code_matched": exact | near}).where((F.col("score") >= floor) | F.col("code_matched"))


def with_name_similarity(rows: DataFrame) -> DataFrame:
    """``rows`` (item_name, name) with ``__alike``; each different name is cleaned once and each different pair of names compared once."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but long work
    rows = stored(rows, "named")
    blank = lambda c: F.coalesce(c, F.lit(""))
    pairs = rows.select(blank("item_name").alias("__a"), blank("name").alias("__b")).distinct()
    names = pairs.select(F.col("__a").alias("n")).union(pairs.select("__b")).distinct().repartition(tasks, "n")
    made = stored(names.select("n", name_features("n").alias("f")), "features")
    left, right = (made.select(F.col("n").alias(c), F.col("f").alias(f"{c}f")) for c in ("__a", "__b"))
    both = pairs.join(left, "__a").join(right, "__b").repartition(tasks, "__a", "__b")
    alike = stored(both.select("__a", "__b", feature_similarity(F.col("__af"), F.col("__bf")).alias("__alike")), "alike")
    return rows.join(alike, (blank(rows["item_name"]) == alike["__a"]) & (blank(rows["name"]) == alike["__b"])).drop("__a", "__b")


def field_aware(rows: DataFrame, with_fields: bool = False) -> DataFrame:
    """max(score, blend of name and score).  Brand and model count only ``with_fields``: the candidates of the original tool lack them."""
    rows = with_name_similarity(rows)
    blend = 0.35 * F.col("__alike") + 0.30 * F.col("score")
    if with_fields:
        qb, cb, qm, cm = (clean_list_text(c) for c in ("item_brand", "brand", "item_model", "model"))
        blend = blend + F.when((qb != "") & (cb != ""), 0.20 * F.when(qb == cb, 1.0).otherwise(0.3)).otherwise(0.0)
        part = F.when(qm == cm, 1.0).when(F.contains(qm, cm) | F.contains(cm, qm), 0.5).otherwise(0.0)
        blend = blend + F.when((qm != "") & (cm != ""), 0.15 * part).otherwise(0.0)
    return rows.withColumn("score", F.greatest("score", F.least(F.lit(1.0), blend))).drop("__alike")


def adjust_by_name(rows: DataFrame) -> DataFrame:
    """Score held down by the name score: no related words x 0.35, a weak name x 0.6; code matches keep theirs."""
    rows = rows.withColumns({"__name": fuzzy_name_udf(F.trim("item_name"), F.trim("name")), "__anchor": anchors_related(significant_tokens("item_name"), significant_tokens("name", 12))})
    low = F.least("score", "__name")
    factor = F.when(~F.col("__anchor"), 0.35).when(F.col("__name") < 0.45, 0.6).otherwise(1.0)
    note = F.when(~F.col("__anchor"), F.lit("no keyword overlap")).when(F.col("__name") < 0.45, F.format_string("weak name match (%.2f)", "__name")).otherwise(F.format_string("name match (%.2f)", "__name"))
    return rows.withColumns({"score": F.when(F.col("code_matched"), F.col("score")).otherwise(F.bround(F.least(F.lit(1.0), low * factor), 4)), "name_note": F.when(F.col("code_matched"), "").otherwise(note)}).drop("__name", "__anchor")


def is_medical(name: Column, description: Column) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(description, F.lit(""))))
    return reduce(or_, [F.contains(text, F.lit(w)) for w in MEDICAL_WORDS])


def is_medical_product(name: Column) -> Column:
    words = F.array_union(significant_tokens(F.lower(name), 12), F.split(F.lower(F.coalesce(name, F.lit(""))), r"\s+"))
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in MEDICAL_NAMES]))


def medical_filter(rows: DataFrame) -> DataFrame:
    """For medical items only medical products with related words stay."""
    related = anchors_related(significant_tokens("item_name"), significant_tokens("name", 12))
    marked = rows.withColumn("__related", related)
    return marked.where(~is_medical(F.col("item_name"), F.col("item_description")) | (is_medical_product(F.col("name")) & F.col("__related"))).drop("__related")


def medical_blocked(rows: DataFrame) -> DataFrame:
    """Candidate rows (item_name, item_description, name, category) with ``blocked``: medical items are offered neither sections nor names that are not medical."""
    bad = F.coalesce(F.col("category").isin(NON_MEDICAL_SECTIONS), F.lit(False)) | ~is_medical_product(F.col("name"))
    return rows.withColumn("blocked", is_medical(F.col("item_name"), F.col("item_description")) & bad)


def heuristic_rank(rows: DataFrame) -> DataFrame:
    """Field-aware blend of (item_name, item_description, name, brand, model, specs, description, similarity): confidence (0 to 100) and explanation."""
    asked = F.array_union(latin_tokens("item_name"), latin_tokens("item_description"))
    specs = F.array_union(latin_tokens("specs"), latin_tokens("description"))

    def overlap(a: Column, b: Column) -> Column:
        return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(jaccard(a, b))

    hit = lambda c: F.when(F.arrays_overlap(latin_tokens(c), asked), 1.0).otherwise(0.0)
    name, spec = overlap(asked, latin_tokens("name")), overlap(latin_tokens("item_description"), specs)
    brand, model, sem = hit("brand"), hit("model"), F.coalesce("similarity", F.lit(0.0))
    blend = 0.35 * sem + 0.25 * name + 0.15 * brand + 0.15 * model + 0.10 * spec
    pct = lambda x: F.concat(F.bround(x * 100).cast("int").cast("string"), F.lit("%"))
    why = F.concat_ws(
        "; ",
        F.when(brand > 0, "brand match"),
        F.when(model > 0, "model match"),
        F.when(name > 0.2, F.concat(F.lit("name overlap "), pct(name))),
        F.when(spec > 0.2, F.concat(F.lit("spec overlap "), pct(spec))),
        F.concat(F.lit("semantic similarity "), pct(sem)),
    )
    return rows.withColumns({"confidence": F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), blend)) * 100, 1), "explanation": why})


def resolve_category(items: DataFrame, names: DataFrame) -> DataFrame:
    """(qid, category, category_name, how): explicit, from the label, from keywords, from a section name alike; names are looked up for what was found.

    ``items``: (qid, category, label, name, description); ``names``: (category,
    category_name), the sections of a code book.  Only items without any other hint are
    compared with the names, each distinct text once; the best ratio from
    ``PARTIAL_RATIO`` counts, of equal ones the smallest section.
    """
    from ledgermill.functions.codes import category_from_keywords, category_from_label

    given = F.nullif(F.trim("category"), F.lit(""))
    label = category_from_label(F.col("label"))
    words = category_from_keywords(F.concat_ws(" ", "name", "description"))
    text = F.lower(F.trim(F.concat_ws(" ", F.nullif("name", F.lit("")), F.nullif("description", F.lit("")))))
    found = items.select("qid", F.coalesce(given, label, words).alias("category"), F.when(given.isNotNull(), "item").when(label.isNotNull(), "label").when(words.isNotNull(), "keywords").alias("how"), text.alias("text"))
    open_ = found.where("category is null and text <> ''").select(F.col("text").alias("qid"), F.col("text").alias("name")).distinct()
    choices = names.where("category_name <> ''").select(F.col("category").alias("id"), F.col("category_name").alias("name"))
    hits, _ = bounded.bounded_search(open_, choices, {"partial": bounded.partial(PARTIAL_RATIO)}, 1)
    alike = hits.groupBy("qid").agg(F.min_by("id", F.struct(-F.col("score"), "id")).alias("alike")).withColumnRenamed("qid", "text")
    settled = found.join(alike, "text", "left").select("qid", F.coalesce("category", "alike").alias("category"), F.coalesce("how", F.when(F.col("alike").isNotNull(), "name")).alias("how"))
    return settled.join(names, "category", "left").select("qid", "category", "category_name", "how")
