"""Review workflow, versions and embeddings over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.functions.codes import classify_item
from ledgermill.operators import embedding, retrieval, workflow
from ledgermill.plans.registry import query, table
from ledgermill.plans.vocabulary import PART_CLASSES


@query(
    "o194_saved_decisions",
    """WITH d AS (SELECT o_orderkey AS qid, o_custkey AS id, CASE o_orderstatus WHEN 'F' THEN 'авто' WHEN 'P' THEN 'вручную' ELSE 'отклонено' END AS decision, CASE WHEN o_orderkey % 2 = 0 THEN 'llm_confirmed' END AS source, o_orderkey % 7 = 0 AS saved FROM orders),
    k AS (SELECT DISTINCT l_orderkey AS qid FROM lineitem)
    SELECT qid, CASE WHEN decision <> 'отклонено' THEN id END AS id, CASE decision WHEN 'авто' THEN 'auto_accepted' WHEN 'вручную' THEN 'user_selected' ELSE 'no_match' END AS decision_type,
    CASE decision WHEN 'авто' THEN CASE WHEN source = 'llm_confirmed' THEN 'llm_auto_matched' ELSE 'exact_match' END WHEN 'вручную' THEN 'hybrid_top3' END AS method, CASE decision WHEN 'отклонено' THEN 'no_match' ELSE 'matched' END AS status
    FROM d SEMI JOIN k USING (qid) WHERE NOT saved""",
)
def saved_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    decision = F.when(F.col("o_orderstatus") == "F", "авто").when(F.col("o_orderstatus") == "P", "вручную").otherwise("отклонено")
    made = table(spark, sf_dir, "orders").select(k.alias("qid"), F.col("o_custkey").alias("id"), decision.alias("decision"), F.when(k % 2 == 0, "llm_confirmed").alias("source"), (k % 7 == 0).alias("saved"))
    return workflow.save_decisions(made, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qid")))


@query(
    "o152_source_merge",
    """WITH c AS (SELECT l_suppkey AS qid, l_partkey AS id, l_returnflag AS source, round(l_discount, 2) AS score FROM lineitem),
    b AS (SELECT qid, id, max(score) AS score, arg_min(source, struct_pack(a := -score, b := source)) AS source FROM c GROUP BY qid, id),
    k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM b)
    SELECT qid, id, score, source, rank, rank = 1 AND score >= 0.1 AS selected FROM k WHERE rank <= 5""",
)
def source_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("qid"), F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("source"), F.round("l_discount", 2).alias("score"))
    return workflow.auto_select(workflow.merge_sources(rows, 5).withColumn("note", F.lit("")), 0.1).drop("note")


@query(
    "o162_version_counts",
    "SELECT c_nationkey AS source_id, count(*) AS products, count(*) FILTER (c_acctbal > 0) AS active FROM customer WHERE c_mktsegment = (SELECT max(c_mktsegment) FROM customer) GROUP BY c_nationkey",
)
def version_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of the current version (the last segment by name) of each nation."""
    c = table(spark, sf_dir, "customer")
    last = c.agg(F.max("c_mktsegment").alias("current"))
    return c.join(F.broadcast(last), F.col("c_mktsegment") == F.col("current")).groupBy(F.col("c_nationkey").alias("source_id")).agg(F.count(F.lit(1)).alias("products"), F.count(F.when(F.col("c_acctbal") > 0, 1)).alias("active"))


@query(
    "o127_nested_matches",
    """WITH m AS (SELECT l_orderkey AS qid, l_linenumber AS rank, l_partkey AS id, p_name AS name FROM lineitem LEFT JOIN part ON p_partkey = l_partkey)
    SELECT o_orderkey AS qid, string_agg(rank || ':' || id || ':' || name, '|' ORDER BY rank, id, name) AS matches FROM orders LEFT JOIN m ON qid = o_orderkey GROUP BY o_orderkey""",
)
def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid"))
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("id"), F.lit(1.0).alias("score"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    line = F.transform("matches", lambda x: F.concat_ws(":", x["rank"].cast("string"), x["id"].cast("string"), x["name"]))
    return workflow.nested_matches(items, m, p).select("qid", F.array_join(line, "|").alias("matches"))


@query(
    "o217_task_progress",
    "SELECT o_custkey AS project, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) AS total, CASE WHEN count(*) FILTER (o_orderstatus = 'F') = count(*) THEN 'closed' ELSE 'open' END AS state FROM orders GROUP BY o_custkey",
)
def task_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.task_progress(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), (F.col("o_orderstatus") == "F").alias("done")))


@query("o218_presence", "SELECT user_id, max(ts) AS last, max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 15 MINUTES AS present FROM events GROUP BY user_id")
def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return workflow.presence(e.select("user_id", "ts"), F.lit(e.agg(F.max("ts")).first()[0]))  # one value


@query("o125_category_pool")
def category_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names that share a class, distinct names only."""
    names = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id")).withColumn("classes", classify_item("name", PART_CLASSES))
    return workflow.category_pool(names.withColumnRenamed("id", "qid"), names)


@query("o75_embedding_search")
def embedding_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct part names by word and character TF-IDF: the five most alike of each."""
    names = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    w = embedding.combined(names, "id", "name")
    return retrieval.top_k(retrieval.sparse_cosine(w, w).where("qid <> id"), 5)


@query("o82_reduced_embedding")
def reduced_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    v = embedding.reduce_rank(embedding.combined(names, "id", "name"), 16)
    return retrieval.vector_search(v.where("id % 100 = 0"), v, 5).where("qid <> id").drop("rank")
