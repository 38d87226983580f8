"""Readers and export tables: spreadsheets made of the relational tables and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.operators import catalog
from ledgermill.plans.maintenance import _CODED, coded_parts
from ledgermill.plans.registry import query, table
from ledgermill.sources import ingest, readers, sinks

_CLEAN = r"trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9а-яё\s]', ' ', 'g'), '\s+', ' ', 'g')), '\bpcs?\b', 'pcs', 'g'), '\s+', ' ', 'g'))"


def _clean_sql(c: str) -> str:
    return _CLEAN.format(f"coalesce({c}, '')")


@query(
    "o12_read_catalog",
    _CODED
    + f""", x AS (SELECT id, CASE WHEN id % 9 = 0 THEN NULL ELSE code END AS code, CASE WHEN id % 11 = 0 THEN 'n/a' ELSE ' ' || name || ' pc' END AS name, CASE WHEN id % 4 = 0 THEN '-' ELSE brand END AS brand, price FROM p)
    SELECT coalesce(upper(code), '') AS code, trim(name) AS name, CASE WHEN brand <> '-' THEN brand END AS brand, floor(price) * 10 + 5 AS price,
           CASE WHEN code IS NOT NULL THEN substr(code, 1, 8) || lpad((CAST(substr(code, 9, 4) AS int) // 100 * 100)::varchar, 4, '0') END AS category_code,
           concat_ws(' ', nullif({_clean_sql("code")}, ''), nullif({_clean_sql("name")}, ''), nullif({_clean_sql("nullif(brand, '-')")}, '')) AS normalized_text,
           CASE WHEN id % 2 = 0 THEN 'even' END AS note
    FROM x WHERE name <> 'n/a'""",
)
def read_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog sheet with headers in two languages, missing marks, and prices with a comma, which the reader drops."""
    p = coded_parts(spark, sf_dir)
    sheet = p.select(
        F.when(F.col("id") % 9 != 0, F.lower("code")).alias("Код"),
        F.when(F.col("id") % 11 == 0, "n/a").otherwise(F.concat(F.lit(" "), "name", F.lit(" pc"))).alias(" Product Name"),
        F.when(F.col("id") % 4 == 0, "-").otherwise(F.col("brand")).alias("BRAND"),
        F.concat(F.floor("price").cast("string"), F.lit(",5")).alias("Цена, тенге"),
        F.when(F.col("id") % 2 == 0, "even").alias("Note"),
    )
    aliases = readers.CATALOG_HEADERS | {"note": ["note"]}
    return readers.read_catalog(sheet, aliases, ("note",)).select("code", "name", "brand", "price", "category_code", "normalized_text", F.col("custom_fields")["note"].alias("note"))


@query(
    "o12_read_items",
    f"""SELECT 'S' || s_suppkey AS item_code, s_name AS item_name, CASE WHEN s_suppkey % 3 <> 0 THEN 'in ' || s_nationkey END AS description, s_nationkey::double AS quantity,
        concat_ws(' ', {_clean_sql("'S' || s_suppkey")}, {_clean_sql("s_name")}, nullif({_clean_sql("CASE WHEN s_suppkey % 3 <> 0 THEN 'in ' || s_nationkey END")}, '')) AS normalized_text FROM supplier WHERE s_suppkey % 7 <> 0""",
)
def read_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    sheet = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), k.cast("string")).alias("Item Code"),
        F.when(k % 7 == 0, "  ").otherwise(F.concat("s_name", F.lit(" "))).alias("Наименование"),
        F.when(k % 3 == 0, "NaN").otherwise(F.concat(F.lit("in "), F.col("s_nationkey").cast("string"))).alias("Desc"),
        F.col("s_nationkey").cast("string").alias("Кол-во"),
    )
    return readers.read_items(sheet).select("item_code", "item_name", "description", "quantity", "normalized_text")


@query(
    "o10_fixed_columns",
    _CODED + " SELECT code AS canonical_code, name, '' AS description, CASE WHEN id % 4 = 0 THEN '' ELSE brand END AS brand, '' AS model, '' AS specs, '' AS price FROM p",
)
def fixed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog without some of its optional columns."""
    p = coded_parts(spark, sf_dir)
    sheet = p.select(F.concat(F.lit(" "), "code").alias("Government Code"), F.col("name").alias("Product Name"), F.lit(None).cast("string").alias("Description"), F.when(F.col("id") % 4 != 0, F.col("brand")).alias("Brand"))
    return readers.read_government_catalog(sheet).select("canonical_code", "name", "description", "brand", "model", "specs", "price")


@query(
    "o11_needs",
    "SELECT p_partkey AS source_row, p_name AS name, row_number() OVER (ORDER BY p_partkey) AS need_index, p_name || ' ' || CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS need_text FROM part WHERE p_partkey % 5 <> 0",
)
def needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    blank = F.lit(None).cast("string")
    sheet = table(spark, sf_dir, "part").select(
        k.alias("source_row"), F.when(k % 5 != 0, F.col("p_name")).otherwise(F.when(k % 2 == 0, "  ")).alias(" Наименование"), blank.alias("Код"), blank.alias("Категория"), F.when(k % 2 == 0, F.col("p_type")).alias("Описание"), blank.alias("Ед.изм."), blank.alias("Кол-во  ")
    )
    return readers.read_needs(sheet).select("source_row", F.col("Наименование").alias("name"), "need_index", "need_text")


@query(
    "o11_price_list",
    "SELECT p_partkey::varchar AS code, p_name || ' ' || CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END || ' ' || p_brand AS catalog_text, CASE WHEN p_partkey % 3 <> 0 THEN p_size::double END AS price FROM part WHERE p_partkey % 5 <> 0",
)
def price_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    sheet = table(spark, sf_dir, "part").select(
        k.cast("string").alias("Код"), F.when(k % 5 != 0, F.col("p_name")).alias("Наименование"), F.when(k % 2 == 0, F.col("p_type")).alias("Описание"), F.lit("шт").alias("Единица  измерения"), F.when(k % 3 != 0, F.col("p_size").cast("string")).otherwise("по запросу").alias("Сметная цена, тг"), F.col("p_brand").alias("поисковый текст")
    )
    return readers.read_price_list(sheet).select(F.col("Код").alias("code"), "catalog_text", F.col("Сметная цена, тенге").alias("price"))


@query(
    "o08_source_aliases",
    """SELECT c_nationkey::bigint AS source_id, CASE WHEN c_nationkey % 2 = 0 THEN 'name' ELSE 'title' END AS header FROM customer GROUP BY c_nationkey HAVING c_nationkey < 6""",
)
def source_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which header holds the name: a source with mappings of its own takes its own header first."""
    nations = table(spark, sf_dir, "customer").where("c_nationkey < 6").select(F.col("c_nationkey").cast("long").alias("source_id")).distinct()
    mappings = nations.where("source_id % 2 = 1").select("source_id", F.lit("name").alias("field_key"), F.lit(" Title ").alias("excel_header"))
    sources = [r["source_id"] for r in nations.collect()]  # six at most
    found = [(s, readers.resolve_headers(["title", "name", "code"], readers.aliases_of_source(mappings, s))["name"]) for s in sources]
    return spark.createDataFrame(found, "source_id long, header string")


_RECORDS = """
    WITH r AS (SELECT p_partkey AS source_row, p_size % 4 AS upload_id, p_partkey % 3 <> 0 OR NULL AS active, '521-' || (100 + p_partkey % 7) || '-' || lpad((p_partkey % 1300)::varchar, 4, '0') AS code, p_partkey % 10 = 0 AS header FROM part)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as records of four uploads, some unmarked, some of them group headers."""
    k = F.col("p_partkey")
    sized = table(spark, sf_dir, "part").select(k.alias("id"), (F.col("p_size") % 4).alias("upload_id"))
    more = coded_parts(spark, sf_dir).withColumns({"source_row": F.col("id"), "active": F.when(F.col("id") % 3 != 0, True), "header": F.col("id") % 10 == 0})
    return more.join(sized, "id")


@query("o15_master_records", _RECORDS + " SELECT source_row FROM r WHERE upload_id = 1 AND coalesce(active, true)")
def master_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.master_records(records(spark, sf_dir), 1).select("source_row")


@query(
    "o205_index_scope",
    _RECORDS
    + """, u AS (SELECT * FROM r WHERE coalesce(active, true) AND NOT header AND NOT (substr(code, 11, 2) = '00' AND substr(code, 9, 4) <> '0000'))
    SELECT 'all' AS scope, source_row FROM u UNION ALL SELECT 'upload', source_row FROM u WHERE upload_id = 2 UNION ALL SELECT 'project', source_row FROM u WHERE upload_id IN (1, 3)""",
)
def index_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index of everything, of one upload and of a project's uploads holds; headers of groups and sections are in none."""
    r = records(spark, sf_dir)
    uploads = spark.range(4).select(F.col("id").cast("int").alias("upload_id"), (F.col("id") % 2).alias("project_id"))
    scopes = {"all": {}, "upload": {"upload_id": 2}, "project": {"project_id": 1}}
    parts = [catalog.index_scope(r, uploads, **kind).select(F.lit(name).alias("scope"), "source_row") for name, kind in scopes.items()]
    return reduce(DataFrame.unionByName, parts)


@query(
    "o16_version_products",
    """WITH r AS (SELECT c_custkey AS id, c_nationkey AS source_id, c_custkey % 3 AS version_id, CASE WHEN c_acctbal < 0 THEN false WHEN c_acctbal < 5000 THEN true END AS active FROM customer), v AS (SELECT DISTINCT source_id, version_id, version_id = 1 AND source_id % 2 = 0 AS is_current FROM r),
    c AS (SELECT source_id, version_id AS now FROM v WHERE is_current)
    SELECT 'current' AS kind, id FROM r LEFT JOIN c USING (source_id) WHERE coalesce(active, true) AND (now IS NULL OR version_id = now) UNION ALL SELECT 'explicit', id FROM r WHERE coalesce(active, true) AND version_id = 2""",
)
def version_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("c_acctbal")
    r = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("source_id"), (F.col("c_custkey") % 3).alias("version_id"), F.when(b < 0, False).when(b < 5000, True).alias("active"))
    v = r.select("source_id", "version_id").distinct().withColumn("is_current", (F.col("version_id") == 1) & (F.col("source_id") % 2 == 0))
    now, explicit = catalog.current_products(r, v), catalog.current_products(r, v, 2)
    return now.select(F.lit("current").alias("kind"), "id").unionByName(explicit.select(F.lit("explicit").alias("kind"), "id"))


@query(
    "o13_ingest",
    """SELECT p_partkey AS source_row, p_name AS product_name, trim(CASE WHEN p_partkey % 3 <> 0 THEN 'шт' END) AS unit, CASE WHEN p_partkey % 4 <> 0 THEN 1000 + p_size + 0.5 END::decimal(14,2) AS price, p_size::decimal(14,3) AS quantity,
        p_partkey % 12 = 0 AS is_group_header, CASE WHEN p_partkey % 2 = 0 THEN p_size * 10.0::double END AS dim_w_mm, CASE WHEN p_partkey % 2 = 0 THEN 200.0::double END AS dim_h_mm, CASE WHEN p_partkey % 2 = 0 THEN 'металл' END AS material, NULL::varchar AS error FROM part WHERE p_partkey % 7 <> 0
    UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'product name is missing' FROM (SELECT * FROM part WHERE p_partkey % 7 = 0 ORDER BY p_partkey LIMIT 1000)""",
)
def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and the error report of a mapped sheet in one listing."""
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    size = F.col("p_size").cast("string")
    rows = table(spark, sf_dir, "part").select(
        k.alias("source_row"),
        none.alias("external_id"),
        F.when(k % 7 == 0, "  ").otherwise(F.col("p_name")).alias("product_name"),
        F.when(k % 2 == 0, "Металлический").alias("description"),
        F.when(k % 3 != 0, " шт ").alias("unit"),
        F.when(k % 4 != 0, F.concat(F.lit("1 "), F.lpad(size, 3, "0"), F.lit(",5"))).alias("price"),
        size.alias("quantity"),
        F.when(k % 2 == 0, F.concat(size, F.lit(" х 20 см"))).alias("dimensions"),
        none.alias("raw"),
    )
    good, bad = ingest.ingest(rows)
    columns = ["source_row", "product_name", "unit", "price", "quantity", "is_group_header", "dim_w_mm", "dim_h_mm", "material"]
    return good.select(*columns, none.alias("error")).unionByName(bad.select("source_row", "error"), allowMissingColumns=True)


_LINES = "WITH m AS (SELECT l_orderkey AS qid, l_partkey AS id, min(l_linenumber) AS rank, max(l_discount) * 10 AS score, max(l_returnflag) AS flag, max(l_linestatus) AS status FROM lineitem GROUP BY 1, 2)"


def matched_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (order, part) as matches."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("id"))
    return g.agg(F.min("l_linenumber").alias("rank"), (F.max("l_discount") * 10).alias("score"), F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status"))


@query(
    "o18_wizard_export",
    _LINES
    + """ SELECT 'order ' || qid AS "Наименование (заявка)", '' AS "Описание (заявка)", rank::varchar AS "Цена (заявка)", CASE WHEN id % 3 = 0 THEN id::varchar ELSE 'K' || id END AS "Код (каталог)", coalesce(p_name, '') AS "Наименование (каталог)",
        coalesce(p_type, '') AS "Описание (каталог)", coalesce(p_size::varchar, '') AS "Цена (каталог)", CASE WHEN rank = 7 THEN '' ELSE round_even(score * 100, 0)::int || '%' END AS "Совпадение %",
        CASE flag WHEN 'R' THEN CASE WHEN id % 5 = 0 THEN 'AUTO_MATCH_AI' ELSE 'AUTO_MATCH' END WHEN 'A' THEN 'NO_MATCH' ELSE CASE status WHEN 'O' THEN 'MANUAL_MATCH' ELSE 'SKIPPED' END END AS "Тип",
        CASE WHEN flag = 'R' OR (flag = 'N' AND status = 'F') THEN 'No' ELSE 'Yes' END AS "Проверено", qid AS "ID строки" FROM m LEFT JOIN part ON p_partkey = id AND p_partkey % 4 <> 0""",
)
def wizard_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matched_lines(spark, sf_dir)
    p = table(spark, sf_dir, "part").where("p_partkey % 4 <> 0")
    rows = m.join(p, F.col("id") == F.col("p_partkey"), "left").select(
        F.col("qid").alias("destination_id"),
        F.concat(F.lit("order "), F.col("qid").cast("string")).alias("destination_name"),
        F.lit(None).cast("string").alias("destination_description"),
        F.col("rank").alias("destination_price"),
        F.col("id").alias("catalog_id"),
        F.when(F.col("id") % 3 != 0, F.concat(F.lit("K"), F.col("id").cast("string"))).otherwise("").alias("catalog_code"),
        F.col("p_name").alias("catalog_name"),
        F.col("p_type").alias("catalog_description"),
        F.col("p_size").alias("catalog_price"),
        F.when(F.col("rank") != 7, F.col("score")).alias("score"),
        F.when(F.col("flag") == "R", "авто").when(F.col("flag") == "A", "отклонено").when(F.col("status") == "O", "вручную").otherwise("пропущено").alias("decision"),
        F.when(F.col("id") % 5 == 0, "llm_confirmed").otherwise("hybrid_threshold").alias("source"),
    )
    return sinks.wizard_export(rows)


_FULL = (
    _LINES
    + """, s AS (SELECT qid, min(id) AS id, arg_min(score, id) AS score, arg_min(flag, id) AS note, arg_min(status, id) = 'F' AS manual FROM m WHERE rank = 1 GROUP BY qid),
    e AS (SELECT 'O' || o_orderkey AS "Item Code", o_orderpriority AS "Item Name", o_orderstatus AS "Item Description", o_custkey AS "Quantity", 'K' || p_partkey AS "Matched Government Code", p_name AS "Matched Product Name", p_brand AS "Matched Brand", p_type AS "Matched Model", p_retailprice AS "Matched Price",
        round_even(score, 3) AS "Confidence Score", note AS "Explanation", CASE WHEN manual THEN 'Yes' ELSE 'No' END AS "Manual Override", CASE WHEN p_partkey IS NULL THEN 'No Match' ELSE 'Matched' END AS "Match Status"
        FROM orders LEFT JOIN s ON qid = o_orderkey LEFT JOIN part ON p_partkey = id AND p_partkey % 5 <> 0)"""
)


def _full(spark: SparkSession, sf_dir: str, least: float | None) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    items = o.select(F.col("o_orderkey").alias("qid"), F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("item_code"), F.col("o_orderpriority").alias("item_name"), F.col("o_orderstatus").alias("description"), F.col("o_custkey").alias("quantity"))
    m = matched_lines(spark, sf_dir).select("qid", "id", "score", (F.col("rank") == 1).alias("selected"), F.col("flag").alias("note"), (F.col("status") == "F").alias("manual"))
    p = table(spark, sf_dir, "part").where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("id"), F.concat(F.lit("K"), F.col("p_partkey").cast("string")).alias("code"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("model"), F.col("p_retailprice").alias("price"))
    return sinks.full_export(items, m, p, least)


@query("o19_full_export", _FULL + " SELECT * FROM e")
def full_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _full(spark, sf_dir, None)


@query("o19_best_export", _FULL + ' SELECT * FROM e WHERE "Confidence Score" >= 0.6')
def best_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _full(spark, sf_dir, 0.6)


@query(
    "o23_variant_export",
    _LINES
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS place FROM m), i AS (SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END AS place FROM orders)
    SELECT pos AS "#", 'order ' || pos AS "Позиция", '' AS "Код", '' AS "Кол-во", CASE WHEN id IS NULL THEN '— не найдено' ELSE 'part ' || id END AS "Подобранный вариант", CASE WHEN id IS NULL THEN '' ELSE 'K' || id END AS "Код каталога",
        CASE WHEN id IS NULL THEN '' WHEN flag = 'R' THEN 'Код ✓' ELSE floor(score * 100 + 0.5)::int || '%' END AS "Уверенность", coalesce(status, '') AS "Пояснение"
    FROM i LEFT JOIN r ON r.qid = pos AND r.place = i.place""",
)
def variant_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgermill.operators.retrieval import top_k

    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    none = F.lit(None).cast("string")
    items = o.select(k.alias("pos"), F.concat(F.lit("order "), k.cast("string")).alias("item_name"), none.alias("code"), none.alias("qty"))
    ranked = top_k(matched_lines(spark, sf_dir).drop("rank"), 1_000_000)
    shown = ranked.select(F.col("qid").alias("pos"), "rank", F.concat(F.lit("part "), F.col("id").cast("string")).alias("name"), F.concat(F.lit("K"), F.col("id").cast("string")).alias("product_code"), "score", (F.col("flag") == "R").alias("code_matched"), F.col("status").alias("note"))
    return sinks.variant_export(items, shown, o.where(k % 4 == 0).select(k.alias("pos"), F.lit(1).alias("variant")))
