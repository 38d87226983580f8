"""Jobs that are killed and go on, and assignments that depend on order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.functions.text import tokenize
from ledgermill.operators import analogs, retrieval
from ledgermill.operators.jobs import MatchingJob
from ledgermill.plans.registry import query, table
from ledgermill.plans.search import _BASE, _COVERAGE, indexed
from ledgermill.sources.store import fresh_path

BATCH = 16


@query(
    "o192_resumed_job",
    _BASE
    + _COVERAGE
    + f""", o AS (SELECT item_id AS qid, row_number() OVER (ORDER BY item_id) AS place FROM benchmark), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM cov) WHERE rank = 1)
    SELECT o.qid, t.id, t.score, (place - 1) // {BATCH} AS batch FROM o LEFT JOIN t USING (qid)""",
)
def resumed_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job over all items that is killed in its second batch, cancelled in a later one and resumed: each item once."""
    index, seen = indexed(spark, sf_dir), []
    job = MatchingJob(spark, fresh_path(spark, "job")).start(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text"))

    def match(batch: DataFrame) -> DataFrame:
        seen.append(1)
        if len(seen) == 2:
            raise InterruptedError("killed")
        if len(seen) == 3:
            job.cancel()  # the batch in hand meets the change of state and is not committed
        asked = retrieval.token_table(batch, "qid", tokenize("text")).withColumnRenamed("id", "qid")
        return batch.select("qid").join(index.coverage(asked, 1).drop("rank"), "qid", "left")

    try:
        job.run(match, BATCH)
        raise AssertionError("the kill went unnoticed")
    except InterruptedError:
        pass
    again = MatchingJob(spark, job.tables.path)  # another process
    if again.progress()["state"] == "running":
        again.run(match, BATCH)
    if again.progress()["state"] == "cancelled":
        again.resume()
    again.run(match, BATCH)
    return again.results().select("qid", "id", "score", F.col("batch").cast("long").alias("batch"))


_ANALOGS = """
    a AS (SELECT p_brand AS grp, p_size AS size, p_partkey AS a, p_retailprice AS price, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part WHERE p_partkey % 3 = 0),
    b AS (SELECT p_brand AS grp, p_size AS size, p_partkey AS b, p_retailprice AS price FROM part WHERE p_partkey % 3 = 1),
    c AS (SELECT a.grp, a.a, a.n, list(b.b ORDER BY round(1 / (1 + abs(a.price - b.price)), 6) DESC, b.b) AS choice, map(list(b.b), list(round(1 / (1 + abs(a.price - b.price)), 6))) AS score FROM a JOIN b ON a.grp = b.grp AND abs(a.size - b.size) <= 2 GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n) AS step FROM c)"""


@query(
    "o123_greedy_analogs",
    "WITH RECURSIVE"
    + _ANALOGS
    + """, s(grp, step, a, b, score, taken) AS (SELECT grp, step, a, choice[1], score[choice[1]], [choice[1]] FROM o WHERE step = 1 UNION ALL
        SELECT o.grp, o.step, o.a, x.b, o.score[x.b], list_append(s.taken, x.b) FROM s JOIN o ON o.grp = s.grp AND o.step = s.step + 1, LATERAL (SELECT list_filter(o.choice, lambda v: NOT list_contains(s.taken, v))[1] AS b) x)
    SELECT grp AS "group", a, b, score FROM s WHERE b IS NOT NULL""",
)
def greedy_analogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a list and their analogs in another one: same brand, sizes at most two apart, the nearest price first."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("group"), F.col("p_size").alias("size"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"))
    a = p.where("id % 3 = 0").select("group", F.col("id").alias("a"), F.col("id").alias("pos"), "size", "price")
    b = p.where("id % 3 = 1").select("group", F.col("id").alias("b"), "size", "price")
    taken = analogs.assign_nearest(a, b, 2)
    return taken.select("group", "a", "b", F.round(1 / (1 + F.abs(F.col("a_price") - F.col("b_price"))), 6).alias("score"))
