"""Result tables in the shape of their export files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.operators.statistics import histogram, match_summary
from ledgermill.sources.ingest import TYPES

# Headers of the files.
WIZARD_HEADERS = ("Наименование (заявка)", "Описание (заявка)", "Цена (заявка)", "Код (каталог)", "Наименование (каталог)", "Описание (каталог)", "Цена (каталог)", "Совпадение %", "Тип", "Проверено", "ID строки")
RESULT_HEADERS = ("Item Code", "Item Name", "Rank", "Government Code", "Product Name", "Brand", "Similarity Score", "Confidence (%)", "Explanation")
VARIANT_HEADERS = ("#", "Позиция", "Код", "Кол-во", "Подобранный вариант", "Код каталога", "Уверенность", "Пояснение")


def _percent(score):
    return F.concat(F.bround(score * 100).cast("int").cast("string"), F.lit("%"))


def wizard_export(rows: DataFrame) -> DataFrame:
    """The eleven columns of a reviewed run.

    ``rows``: (destination_id, destination_name, destination_description,
    destination_price, catalog_id, catalog_code, catalog_name, catalog_description,
    catalog_price, score, decision, source).
    """
    kind = F.coalesce(*[F.when(F.col("decision") == d, F.lit(t)) for d, t in TYPES.items()], F.lit("NO_MATCH"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    given = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    values = (
        F.col("destination_name"),
        text("destination_description"),
        text("destination_price"),
        F.coalesce(given("catalog_code"), given("catalog_id"), F.lit("")),
        text("catalog_name"),
        text("catalog_description"),
        text("catalog_price"),
        F.coalesce(_percent(F.col("score")), F.lit("")),
        F.when((F.col("decision") == "авто") & (F.col("source") == "llm_confirmed"), "AUTO_MATCH_AI").otherwise(kind),
        F.when(F.col("decision").isin("авто", "пропущено"), "No").otherwise("Yes"),
        F.col("destination_id"),
    )
    return rows.select(*[v.alias(h) for v, h in zip(values, WIZARD_HEADERS)])


def full_export(items: DataFrame, matches: DataFrame, products: DataFrame, least: float | None = None) -> DataFrame:
    """Every item with its selected match and product; with ``least`` only matches of that confidence.

    ``items``: (qid, item_code, item_name, description, quantity); ``matches``: (qid, id,
    score, selected, note, manual); ``products``: (id, code, name, brand, model, price).
    Of several selected matches the one with the smallest id stands.
    """
    chosen = matches.where("selected").groupBy("qid").agg(F.min_by(F.struct("id", "score", "note", "manual"), "id").alias("m"))
    chosen = chosen.select("qid", "m.*", F.lit(True).alias("found"))
    joined = items.join(chosen, "qid", "left").join(products.withColumnRenamed("id", "pid"), F.col("id") == F.col("pid"), "left")
    kept = joined if least is None else joined.where(F.col("score") >= least)
    return kept.select(
        F.col("item_code").alias("Item Code"),
        F.col("item_name").alias("Item Name"),
        F.col("description").alias("Item Description"),
        F.col("quantity").alias("Quantity"),
        F.col("code").alias("Matched Government Code"),
        F.col("name").alias("Matched Product Name"),
        F.col("brand").alias("Matched Brand"),
        F.col("model").alias("Matched Model"),
        F.col("price").alias("Matched Price"),
        F.bround("score", 3).alias("Confidence Score"),
        F.col("note").alias("Explanation"),
        F.when(F.coalesce("manual", F.lit(False)), "Yes").otherwise("No").alias("Manual Override"),
        F.when(F.col("pid").isNotNull(), "Matched").otherwise("No Match").alias("Match Status"),
    )


def ranked_export(rows: DataFrame) -> DataFrame:
    """The fixed columns of the rank table."""
    fields = ("item_code", "item_name", "rank", "code", "name", "brand", "similarity", "confidence", "explanation")
    return rows.select(*[F.col(c).alias(h) for c, h in zip(fields, RESULT_HEADERS)])


def three_sheets(matches: DataFrame) -> dict[str, DataFrame]:
    """The sheets of a blended run: the matches, their summary and the distribution of their scores."""
    return {"matches": matches, "summary": match_summary(matches), "score_distribution": histogram(matches.where("match_type is not null"))}


def variant_export(items: DataFrame, candidates: DataFrame, selections: DataFrame) -> DataFrame:
    """One row per item with the variant that was selected (pos, variant from 0), by default the first.

    ``items``: (pos from 1, item_name, code, qty); ``candidates``: (pos, rank from 1, name,
    product_code, score, code_matched, note).
    """
    chosen = items.join(selections.select("pos", "variant"), "pos", "left").withColumn("rank", F.coalesce("variant", F.lit(0)) + 1)
    joined = chosen.join(candidates, ["pos", "rank"], "left")
    there = F.col("name").isNotNull()
    sure = F.when(F.col("code_matched"), "Код ✓").otherwise(F.concat(F.floor(F.col("score") * 100 + 0.5).cast("int").cast("string"), F.lit("%")))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    values = (F.col("pos"), F.col("item_name"), text("code"), text("qty"), F.when(there, F.col("name")).otherwise("— не найдено"), text("product_code"), F.when(there, sure).otherwise(""), text("note"))
    return joined.select(*[v.alias(h) for v, h in zip(values, VARIANT_HEADERS)])
