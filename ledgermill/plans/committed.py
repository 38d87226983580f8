"""The catalog as committed tables: a run of changes, read at several versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.operators.committed import Catalog
from ledgermill.plans.registry import query, table
from ledgermill.sources.store import fresh_path
from ledgermill.sources.versioned import Conflict

_P = """
    WITH p AS (SELECT p_partkey AS id, p_size % 3 AS version_id, 'K' || p_partkey AS code, p_name AS name, p_retailprice AS price, p_partkey % 4 <> 0 AS active FROM part),
    m AS (SELECT DISTINCT l_orderkey AS qid, l_partkey AS id FROM lineitem WHERE l_linenumber = 1),
    merged AS (SELECT id, version_id, code, CASE WHEN version_id = 0 AND id % 5 <> 0 THEN name || ' rev' ELSE name END AS name, CASE WHEN version_id = 0 AND id % 5 <> 0 THEN price + 1 ELSE price END AS price,
                      CASE WHEN version_id = 0 AND id % 5 <> 0 THEN true ELSE active END AS active FROM p
               UNION ALL SELECT id + 1000000, 0, 'N' || id, name, price, true FROM p WHERE version_id = 0 AND id % 7 = 0),
    off AS (SELECT id, version_id, code, name, price, CASE WHEN id % 10 = 3 THEN false ELSE active END AS active FROM merged),
    swapped AS (SELECT * FROM off WHERE version_id <> 1 UNION ALL SELECT id + 2000000, 1, code, name, price, true FROM p WHERE version_id = 1 AND id % 2 = 0)"""


#: Lists that number their products on their own: the first one, the revision, the replaced version.
LISTS, LIST_STEP = 3, 1_000_000


def _key(number: Column, of_list: int) -> Column:
    """The catalog's own key of a list's product, so that equal numbers of two lists stay two products."""
    return (number.cast("long") * LISTS + of_list).alias("id")


def _number() -> Column:
    """The number that a list shows for a key: its parts' numbers, shifted by ``LIST_STEP`` a list."""
    of_list = F.pmod(F.col("id"), F.lit(LISTS))
    return ((F.col("id") - of_list) / LISTS).cast("long") + of_list * LIST_STEP


def changed_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """Parts in three versions, then: a revised list, a soft delete, a replaced version, a new current one."""
    part = table(spark, sf_dir, "part")
    none = F.lit(None).cast("string")
    products = part.select(_key(F.col("p_partkey"), 0), (F.col("p_size") % 3).alias("version_id"), F.concat(F.lit("K"), F.col("p_partkey").cast("string")).alias("code"), F.col("p_name").alias("name"), none.alias("brand"), none.alias("model"), F.col("p_retailprice").alias("price"), (F.col("p_partkey") % 4 != 0).alias("active"))
    versions = spark.range(3).select(F.col("id").cast("int").alias("version_id"), F.lit(1).alias("source_id"), (F.col("id") == 0).alias("is_current"))
    matches = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("qid"), _key(F.col("l_partkey"), 0)).distinct().withColumn("score", F.lit(1.0))
    made = Catalog(spark, fresh_path(spark, "catalog"))
    made.create(products, versions, matches)
    late = Catalog(spark, made.tables.path)
    own = products.where("version_id = 0")
    revised = own.where(_number() % 5 != 0).select("id", "code", F.concat("name", F.lit(" rev")).alias("name"), (F.col("price") + 1).alias("price"))
    new = own.where(_number() % 7 == 0).select(_key(_number(), 1), F.concat(F.lit("N"), _number().cast("string")), "name", "price")
    made.merge(revised.union(new), 0)
    gone = made.read("products").where(_number() % 10 == 3).select("id")
    try:
        late.set_active(gone, False)  # began before the merge
        raise AssertionError("a second writer was let in")
    except Conflict:
        late.refresh().set_active(gone, False)
    made.refresh().replace_version(1, products.where((F.col("version_id") == 1) & (_number() % 2 == 0)).withColumns({"id": _key(_number(), 2), "active": F.lit(True)}))
    made.set_current(1)
    return made


@query("o198_committed_products", _P + " SELECT id, version_id, code, name, price, active FROM swapped")
def committed_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed_catalog(spark, sf_dir).read("products").drop("brand", "model").withColumn("id", _number())


@query("o118_committed_versions", _P + " SELECT 1 AS version, version_id, count(*) AS n, count(*) FILTER (active) AS active FROM p GROUP BY ALL UNION ALL SELECT 2, version_id, count(*), count(*) FILTER (active) FROM merged GROUP BY ALL UNION ALL SELECT 3, version_id, count(*), count(*) FILTER (active) FROM off GROUP BY ALL UNION ALL SELECT 5, version_id, count(*), count(*) FILTER (active) FROM swapped GROUP BY ALL")
def committed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each list as every commit left them."""
    made, rows = changed_catalog(spark, sf_dir), None
    for v in (1, 2, 3, 5):
        n = F.count(F.lit(1)).alias("n")
        one = made.read("products", v).groupBy("version_id").agg(n, F.count(F.when(F.col("active"), 1)).alias("active")).select(F.lit(v).alias("version"), "version_id", "n", "active")
        rows = one if rows is None else rows.union(one)
    return rows


@query("o201_committed_matches", _P + " SELECT m.qid, m.id, 1.0::double AS score, v.version_id, v.version_id = 1 AS is_current FROM m JOIN p USING (id) JOIN (SELECT unnest([0, 2]) AS version_id) v USING (version_id)")
def committed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches that are left after a list was replaced, with the state of their version."""
    made = changed_catalog(spark, sf_dir)
    left = made.read("matches").join(made.read("products").select("id", "version_id"), "id")
    return left.join(made.read("versions").select("version_id", "is_current"), "version_id").select("qid", _number().alias("id"), "score", "version_id", "is_current")
