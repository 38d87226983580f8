"""Workbooks made of a table and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.plans.registry import query, table
from ledgermill.sources import workbook
from ledgermill.sources.store import stored

ROWS_PER_BOOK = 700


def part_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): all parts in workbooks of 700 rows, kept as a table."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("Код"), F.concat_ws(" & <", "p_name", "p_brand").alias("Наименование"), F.when(F.col("p_size") % 7 != 0, F.col("p_type")).alias("Единица измерения"), F.col("p_retailprice").alias("Цена"))
    return stored(workbook.made_workbooks(parts, "Код", ROWS_PER_BOOK, "Каталог"), "books")


@query(
    "o24_workbook_rows",
    f"""WITH p AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS n FROM part)
    SELECT 'export-' || lpad((n // {ROWS_PER_BOOK} + 1)::varchar, 5, '0') || '.xlsx' AS file, (n % {ROWS_PER_BOOK} + 2)::int AS row, p_partkey AS code, p_name || ' & <' || p_brand AS name, CASE WHEN p_size % 7 <> 0 THEN p_type END AS unit, p_retailprice AS price FROM p""",
)
def workbook_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its 1-based row number: headers found, columns mapped, numbers read."""
    rows = workbook.records(workbook.workbook_rows(part_books(spark, sf_dir)))
    f = lambda name: F.col("fields")[name]
    return rows.select("file", "row", f("Код").cast("long").alias("code"), f("Наименование").alias("name"), f("Единица измерения").alias("unit"), f("Цена").cast("double").alias("price"))


@query(
    "o01_workbook_sheets",
    f"""WITH p AS (SELECT (row_number() OVER (ORDER BY p_partkey) - 1) // {ROWS_PER_BOOK} + 1 AS b FROM part)
    SELECT 'export-' || lpad(b::varchar, 5, '0') || '.xlsx' AS file, 'Каталог' AS sheet, count(*) + 1 AS n_rows, 4 AS n_columns, 'Код|Наименование|Единица измерения|Цена' AS headers, count(*)::int AS preview_rows FROM p GROUP BY b""",
)
def workbook_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = workbook.list_sheets(stored(workbook.workbook_rows(part_books(spark, sf_dir)), "sheet-rows"))
    return found.select("file", "sheet", "n_rows", "n_columns", F.array_join("headers", "|").alias("headers"), "preview_rows")
