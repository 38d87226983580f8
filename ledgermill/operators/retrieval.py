"""Candidate retrieval as joins: inverted index, IDF, BM25, coverage, TF-IDF, vectors, codes, fuzzy names.

Postings, document frequencies and norms are ordinary tables, so a catalog is indexed
once and joined with all requests.  Tokens meet in an equi-join; a token's rows are
combined per task before the shuffle.  Requests of a checked size are broadcast, so
that the postings of a large catalog never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.functions.codes import looks_like_code, saturate
from ledgermill.functions.text import tokenize
from ledgermill.operators import bounded

#: Requests up to this number are broadcast (vectors and names of about 100 MB at most).
BROADCAST_REQUESTS = 10_000


def top_k(hits: DataFrame, k: int, by: str = "score", query: str = "qid", item: str = "id", rank: str = "rank") -> DataFrame:
    """The ``k`` best hits of each request, numbered from 1; ties go to the smaller id."""
    order = Window.partitionBy(query).orderBy(F.desc(by), F.asc(item))
    return hits.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def small(df: DataFrame, most: int = BROADCAST_REQUESTS) -> DataFrame:
    """Broadcasts ``df`` if it has at most ``most`` rows; a larger one is left to Spark."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def token_table(df: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """(id, token, tf) of all rows, group headers left out by the caller."""
    return df.select(F.col(id_col).alias("id"), F.explode(tokens).alias("token")).groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"))


def postings(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    return token_table(df, id_col, tokenize(text_col))


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def bm25(queries: DataFrame, post: DataFrame, n_docs: int, k: int = 20, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(qid, id, raw, score, rank) of Okapi BM25; repeated query tokens count each time.

    ``queries``: (qid, token, tf).  A negative IDF is replaced by ``epsilon`` times the mean IDF.
    """
    df = document_frequency(post)
    idf = F.log(F.lit(float(n_docs)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean = df.agg((F.lit(epsilon) * F.avg(idf)).alias("floor"))
    lengths = post.groupBy("id").agg(F.sum("tf").alias("dl"))
    total = lengths.agg((F.sum("dl") / F.lit(float(n_docs))).alias("avgdl"))
    wanted = queries.join(df, "token").crossJoin(F.broadcast(mean)).withColumn("idf", F.when(idf < 0, F.col("floor")).otherwise(idf)).select("qid", "token", F.col("tf").alias("qtf"), "idf")
    hit = post.join(small(wanted, 1_000_000), "token").join(lengths, "id").crossJoin(F.broadcast(total))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    raw = hit.groupBy("qid", "id").agg(F.round(F.sum(part), 6).alias("raw")).where("raw > 0")
    return top_k(raw, k, "raw").withColumn("score", F.round(saturate(F.col("raw")), 6))


def coverage(queries: DataFrame, post: DataFrame, n_docs: int) -> DataFrame:
    """(qid, id, score): the share of a request's IDF mass that a document holds.

    ``queries``: (qid, token) distinct.  IDF is ln(1 + N / (1 + df)), unseen tokens have ln(1 + N).
    """
    n = float(max(n_docs, 1))
    df = document_frequency(post)
    weighed = queries.join(df, "token", "left").select("qid", "token", F.when(F.col("df").isNull(), F.log(F.lit(1 + n))).otherwise(F.log(1 + n / (1 + F.col("df")))).alias("idf"))
    total = weighed.groupBy("qid").agg(F.sum("idf").alias("total"))
    held = post.select("id", "token").join(small(weighed, 1_000_000), "token").groupBy("qid", "id").agg(F.sum("idf").alias("held"))
    return held.join(small(total), "qid").select("qid", "id", F.round(F.col("held") / F.col("total"), 6).alias("score"))


def tfidf(terms: DataFrame, n_docs: int, sublinear: bool = False) -> DataFrame:
    """(id, token, weight): smooth IDF ln((1 + n) / (1 + df)) + 1, rows of unit length."""
    df = document_frequency(terms)
    tf = 1 + F.log("tf") if sublinear else F.col("tf")
    raw = terms.join(df, "token").select("id", "token", (tf * (F.log((1.0 + n_docs) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "id").select("id", "token", (F.col("w") / F.col("norm")).alias("weight"))


def sparse_cosine(a: DataFrame, b: DataFrame) -> DataFrame:
    """(qid, id, score) of rows that share a term; ``a`` is the side of the requests."""
    left = small(a.select(F.col("id").alias("qid"), "token", F.col("weight").alias("qw")), 1_000_000)
    return b.join(left, "token").groupBy("qid", "id").agg(F.round(F.sum(F.col("qw") * F.col("weight")), 6).alias("score"))


def vector_search(queries: DataFrame, catalog: DataFrame, k: int = 20) -> DataFrame:
    """(qid, id, score, rank) by cosine, not below 0, of (id, vector) on both sides; exact, see ``vectors``."""
    from ledgermill.operators.vectors import VectorIndex

    return VectorIndex(catalog).search(queries, k)[0]


def code_search(items: DataFrame, products: DataFrame, k: int = 20, at_least: float = 0.8) -> DataFrame:
    """(qid, id, score, exact, rank): equal codes at 0.95, similar ones of a request that looks like a code up to 0.90.

    Distinct codes are compared in order of the bound that their characters set, see
    ``bounded``.  The k best codes, equal ratios in order of their smallest id, hold the
    k best ids.
    """
    q = items.select("qid", F.trim("code").alias("qcode")).where("qcode <> ''")
    p = products.select("id", F.trim("code").alias("code")).where("code <> ''")
    exact = q.join(p, q["qcode"] == p["code"]).select("qid", "id", F.lit(0.95).alias("score"), F.lit(True).alias("exact"))
    asked = q.where(looks_like_code("qcode")).select("qid", F.col("qcode").alias("name"))
    alike, _ = bounded.bounded_search(asked, p.select("id", F.col("code").alias("name")), {"code": bounded.plain_ratio(at_least)}, k)
    near = alike.select("qid", "id", F.least(F.lit(0.9), 0.7 + 0.2 * F.col("score")).alias("score"), F.lit(False).alias("exact"))
    return top_k(exact.unionByName(near), k)


def fuzzy_search(queries: DataFrame, catalog: DataFrame, k: int = 20, others: bool = False) -> DataFrame:
    """(qid, id, score, rank): top k by each of two ratios, the better one kept, then top k; of (qid, name) and (id, name)."""
    kinds = {"set": bounded.TOKEN_SET, "weighted": bounded.WEIGHTED}
    hits, _ = bounded.bounded_search(queries.where(F.trim("name") != ""), catalog, kinds, k, others)
    return top_k(hits.groupBy("qid", "id").agg(F.max("score").alias("score")), k)


def fuzzy_names(queries: DataFrame, catalog: DataFrame, k: int = 20, at_least: float = 0.55, others: bool = False) -> DataFrame:
    """(qid, id, score, rank) by the strict name score; of (qid, name) and (id, name)."""
    hits, _ = bounded.bounded_search(queries, catalog, {"name": bounded.strict_name(at_least)}, k, others)
    return top_k(hits.select("qid", "id", "score"), k)
