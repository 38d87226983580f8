"""Raw rows to catalog and request tables, and results to files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.functions.codes import attributes
from ledgermill.functions.text import normalize_text, to_number

REPORTED = 1000
#: Decision words of the review screen and what the export calls them; fixed values.
TYPES = {"авто": "AUTO_MATCH", "вручную": "MANUAL_MATCH", "отклонено": "NO_MATCH", "без совпадения": "NO_MATCH", "пропущено": "SKIPPED"}


def ingest(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of mapped rows (source_row, external_id, product_name, description, unit, price, quantity, dimensions, raw).

    Rows without a name are errors, of which the report holds the first 1,000.  Numbers
    that cannot be read are null.  A row without unit and price is a group header.
    """
    name = F.nullif(F.trim("product_name"), F.lit(""))
    bad = rows.where(name.isNull()).select("source_row", F.lit("product name is missing").alias("error")).orderBy("source_row").limit(REPORTED)
    a = attributes("product_name", "description", "dimensions", "unit")
    unit = F.left(F.nullif(F.trim("unit"), F.lit("")), F.lit(64))
    price, quantity = to_number("price").cast("decimal(14,2)"), to_number("quantity").cast("decimal(14,3)")
    good = rows.where(name.isNotNull()).withColumn("__a", a)
    return good.select(
        "source_row",
        F.left(F.trim("external_id"), F.lit(255)).alias("external_id"),
        name.alias("product_name"),
        normalize_text("product_name").alias("normalized_name"),
        "description",
        unit.alias("unit"),
        price.alias("price"),
        quantity.alias("quantity"),
        (unit.isNull() & price.isNull()).alias("is_group_header"),
        F.col("__a.dims.w").alias("dim_w_mm"),
        F.col("__a.dims.h").alias("dim_h_mm"),
        F.col("__a.dims.d").alias("dim_d_mm"),
        F.col("__a.material").alias("material"),
        F.col("__a.unit").alias("unit_normalized"),
        "raw",
    ), bad


def export_rows(rows: DataFrame) -> DataFrame:
    """The export of reviewed matches: type, reviewed and percent from decision, source and score."""
    kind = F.coalesce(*[F.when(F.col("decision") == d, F.lit(t)) for d, t in TYPES.items()], F.lit("NO_MATCH"))
    return rows.select(
        "qid",
        F.coalesce("request_name", F.lit("")).alias("request_name"),
        F.coalesce("code", "id", F.lit("")).alias("catalog_code"),
        F.coalesce("name", F.lit("")).alias("catalog_name"),
        F.when(F.col("score").isNotNull(), F.concat(F.bround(F.col("score") * 100).cast("int").cast("string"), F.lit("%"))).otherwise("").alias("confidence"),
        F.when((F.col("decision") == "авто") & (F.col("source") == "llm_confirmed"), "AUTO_MATCH_AI").otherwise(kind).alias("type"),
        F.when(F.col("decision").isin("авто", "пропущено"), "No").otherwise("Yes").alias("reviewed"),
    )


def write_batches(rows: DataFrame, path: str, per_file: int, format: str = "csv") -> None:
    """Files of at most ``per_file`` rows; an empty table leaves one empty file."""
    rows.write.option("maxRecordsPerFile", per_file).option("header", True).mode("overwrite").format(format).save(path)
