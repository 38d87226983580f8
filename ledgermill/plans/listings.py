"""Listings, counts and small lookups over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgermill.operators import workflow
from ledgermill.operators.statistics import batches, count_of
from ledgermill.plans.registry import query, table
from ledgermill.plans.search import _STOP, _TOKENS, indexed


@query(
    "o104_match_buckets",
    "WITH b AS (SELECT l_orderkey, max(l_discount) * 10 AS best, max(l_discount) FILTER (l_linenumber = 1) * 10 AS selected FROM lineitem GROUP BY l_orderkey) SELECT CASE WHEN selected >= 0.8 THEN 'matched' WHEN best >= 0.7 AND best < 0.8 THEN 'review' ELSE 'none' END AS bucket, count(*) AS n FROM b GROUP BY 1",
)
def match_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("l_discount")
    b = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.max(d) * 10).alias("best"), (F.max(F.when(F.col("l_linenumber") == 1, d)) * 10).alias("selected"))
    bucket = F.when(F.col("selected") >= 0.8, "matched").when((F.col("best") >= 0.7) & (F.col("best") < 0.8), "review").otherwise("none")
    return b.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("o105_upload_filter", "SELECT p_partkey FROM part WHERE p_brand = 'Brand#11' AND p_size IS NOT NULL")
def upload_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where((F.col("p_brand") == "Brand#11") & F.col("p_size").isNotNull()).select("p_partkey")


@query(
    "o144_resumable_uploads",
    """WITH n AS (SELECT o_custkey, max(o_orderdate) AS newest FROM orders GROUP BY o_custkey ORDER BY newest DESC, o_custkey LIMIT 20)
    SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus <> 'O') AS decided FROM orders SEMI JOIN n USING (o_custkey) GROUP BY o_custkey HAVING count(*) FILTER (o_orderstatus = 'O') > 0""",
)
def resumable_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty newest groups first, then those of them with open rows."""
    o = table(spark, sf_dir, "orders")
    newest = o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("newest")).orderBy(F.desc("newest"), "o_custkey").limit(20)
    open_ = F.col("o_orderstatus") == "O"
    counts = o.join(F.broadcast(newest.select("o_custkey")), "o_custkey", "left_semi").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("total"), count_of(open_).alias("pending"), count_of(~open_).alias("decided"))
    return counts.where("pending > 0")


@query(
    "o149_index_stats",
    f"""SELECT (SELECT count(*) FROM documents) AS documents, count(DISTINCT doc_id) AS indexed, count(DISTINCT token) AS tokens
    FROM (SELECT doc_id, unnest({_TOKENS.format("text")}) AS token FROM documents) WHERE token NOT IN {_STOP}""",
)
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the kept index: documents, those with a token, and distinct tokens."""
    index = indexed(spark, sf_dir)
    documents = index.tables.read("documents").agg(F.count(F.lit(1)).alias("documents"), F.count(F.when(F.size("tokens") > 0, 1)).alias("indexed"))
    return documents.crossJoin(F.broadcast(index.document_frequency().agg(F.count(F.lit(1)).alias("tokens"))))  # single rows


@query("o181_newest_first", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the twenty newest."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20)


@query("o195_confirm_types", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber BETWEEN 1 AND 3 THEN 'user_selected' ELSE 'manual_search_selected' END AS decision FROM lineitem")
def confirm_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", workflow.decision_for_rank(F.col("l_linenumber")).alias("decision"))


@query(
    "o196_manual_select",
    """WITH m AS (SELECT l_orderkey AS qid, l_partkey AS id, min(l_linenumber) AS rank, max(l_discount) AS score FROM lineitem GROUP BY 1, 2), c AS (SELECT o_orderkey AS qid, o_custkey AS id FROM orders WHERE o_orderstatus = 'P')
    SELECT m.qid, m.id, rank, score, CASE WHEN c.qid IS NULL THEN rank = 1 ELSE m.id = c.id END AS selected FROM m LEFT JOIN c USING (qid) UNION ALL SELECT qid, id, 0, 1.0, true FROM c ANTI JOIN m USING (qid, id)""",
)
def manual_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("id")).agg(F.min("l_linenumber").alias("rank"), F.max("l_discount").alias("score"))
    c = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("qid"), F.col("o_custkey").alias("id"))
    return workflow.select_manually(m.withColumn("selected", F.col("rank") == 1), c)


@query("o201_set_current", "SELECT c_custkey AS version_id, c_nationkey AS source_id, CASE WHEN c_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 7) THEN c_custkey = 7 ELSE c_acctbal > 0 END AS is_current FROM customer")
def set_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("version_id"), F.col("c_nationkey").alias("source_id"), (F.col("c_acctbal") > 0).alias("is_current"))
    return workflow.set_current(v, 7).select("version_id", "source_id", "is_current")


@query("o208_field_order", "SELECT p_brand AS source_id, p_partkey AS field_key, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) * 10 AS position FROM part")
def field_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.reorder(table(spark, sf_dir, "part").select(F.col("p_brand").alias("source_id"), F.col("p_partkey").alias("field_key"), F.col("p_size").alias("position"))).withColumn("position", F.col("position").cast("long"))


@query("o93_fixed_chunks", "SELECT item // 10 AS chunk, count(*) AS n, min(item_id) AS first FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS item FROM benchmark) GROUP BY 1")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in calls of ten; a request list is one list."""
    chunks = batches(table(spark, sf_dir, "benchmark").select("item_id"), ["item_id"], 10)
    return chunks.groupBy((F.col("batch") - 1).alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("first"))
