"""Retrieval and fusion over requests (``benchmark``) and catalog (``documents``), vectors and parts."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.functions.text import tokenize
from ledgermill.operators import fusion, statistics
from ledgermill.operators import retrieval as r
from ledgermill.operators.index import SearchIndex
from ledgermill.operators.tfidf import tfidf_best
from ledgermill.plans.registry import query, table
from ledgermill.sources.store import fresh_path, shared_dir

_TOKENS = "regexp_extract_all(lower({0}), '[a-zа-яәғқңөұүһі0-9]+')"
_STOP = "('для','и','в','с','со','на','из','по','от','до','или','а','к','о','об','при','под','над','за','не','the','шт','штук','штука','мм','см','м','кг','г','л','мл','компл','уп','пач','және','үшін','мен','бен','пен')"
_BASE = f"""
    WITH post AS (SELECT doc_id AS id, token, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS.format("text")}) AS token FROM documents) WHERE token NOT IN {_STOP} GROUP BY ALL),
    q AS (SELECT item_id AS qid, token, count(*) AS qtf FROM (SELECT item_id, unnest({_TOKENS.format("text")}) AS token FROM benchmark) WHERE token NOT IN {_STOP} GROUP BY ALL),
    n AS (SELECT count(*)::double AS n FROM documents), df AS (SELECT token, count(*) AS df FROM post GROUP BY token)"""
_COVERAGE = """,
    w AS (SELECT qid, token, CASE WHEN df IS NULL THEN ln(1 + n) ELSE ln(1 + n / (1 + df)) END AS idf FROM q LEFT JOIN df USING (token), n),
    tot AS (SELECT qid, sum(idf) AS total FROM w GROUP BY qid),
    cov AS (SELECT qid, id, round(sum(idf) / any_value(total), 6) AS score FROM w JOIN post USING (token) JOIN tot USING (qid) GROUP BY qid, id)"""
_BM25 = """,
    idf0 AS (SELECT token, ln(n - df + 0.5::double) - ln(df + 0.5::double) AS idf FROM df, n),
    flr AS (SELECT 0.25::double * avg(idf) AS f FROM idf0), dl AS (SELECT id, sum(tf) AS dl FROM post GROUP BY id), av AS (SELECT sum(dl) / any_value(n) AS avgdl FROM dl, n),
    bm AS (SELECT qid, post.id, round(sum(qtf * CASE WHEN idf < 0 THEN f ELSE idf END * post.tf * 2.5::double / (post.tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl))), 6) AS raw
           FROM q JOIN idf0 USING (token) JOIN post USING (token) JOIN dl ON dl.id = post.id, flr, av GROUP BY qid, post.id HAVING raw > 0),
    bmk AS (SELECT qid, id, raw, row_number() OVER (PARTITION BY qid ORDER BY raw DESC, id) AS rank, round(1 - exp(-raw / 6.0::double), 6) AS score FROM bm)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, token, tf) of the items."""
    return r.token_table(table(spark, sf_dir, "benchmark"), "item_id", tokenize("text")).withColumnRenamed("id", "qid")


def indexed(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """The index of the documents, built where these files have none yet in the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in fs.listStatus(path))
    index = SearchIndex(spark, f"{shared_dir(spark)}/indexes/{hashlib.sha256(chr(10).join(files).encode()).hexdigest()}")
    if not index.is_built:
        index.build(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return index


@query("o73_coverage_topk", _BASE + _COVERAGE + " SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM cov) WHERE rank <= 3")
def coverage_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(spark, sf_dir).coverage(requests(spark, sf_dir), 3)


@query("o70_bm25_topk", _BASE + _BM25 + " SELECT qid, id, raw, score, rank FROM bmk WHERE rank <= 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(spark, sf_dir).bm25(requests(spark, sf_dir), 20)


@query("o150_document_frequency", _BASE + " SELECT token, df FROM df")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(spark, sf_dir).document_frequency()


_CHANGED = (_BASE + _COVERAGE + _BM25).replace("FROM documents", "FROM changed").replace("WITH post", "WITH changed AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'quagga quagga ' || text ELSE text END AS text FROM documents WHERE doc_id % 77 <> 3 UNION ALL SELECT 1000000000 + item_id, text FROM benchmark WHERE item_id % 4 = 0), post", 1)


@query("o205_index_changes", _CHANGED + " SELECT qid, id, raw AS score, rank, 'bm25' AS kind FROM bmk WHERE rank <= 5 UNION ALL SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank, 'coverage' FROM cov) WHERE rank <= 5")
def index_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches after a commit of replaced, new and deleted documents to an index of the documents as they were."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    index = SearchIndex(spark, fresh_path(spark, "index")).build(docs.select(F.col("doc_id").alias("id"), "text"))
    put = docs.where("doc_id % 50 = 0 and doc_id % 77 <> 3").select(F.col("doc_id").alias("id"), F.concat(F.lit("quagga quagga "), "text").alias("text"))
    new = items.where("item_id % 4 = 0").select(F.col("item_id") + 1_000_000_000, "text")
    index.change(put.union(new), docs.where("doc_id % 77 = 3").select(F.col("doc_id").alias("id")))
    asked = requests(spark, sf_dir)
    one = index.bm25(asked, 5).select("qid", "id", F.col("raw").alias("score"), "rank", F.lit("bm25").alias("kind"))
    return one.union(index.coverage(asked, 5).select("qid", "id", "score", "rank", F.lit("coverage").alias("kind")))


_NGRAM = "regexp_extract_all(lower(text), '[a-z0-9_]+')"


_TFIDF = f"""
    WITH d AS (SELECT doc_id AS id, {_NGRAM} AS t FROM documents UNION ALL SELECT -1 - item_id, {_NGRAM} FROM benchmark),
    g AS (SELECT id, unnest(t) AS token FROM d UNION ALL SELECT id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM d WHERE len(t) > 1),
    terms AS (SELECT id, token, count(*) AS tf FROM g GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM terms GROUP BY token), n AS (SELECT count(*) AS n FROM d),
    raw AS (SELECT id, token, tf * (ln((1.0::double + n) / (1 + df)) + 1) AS w FROM terms JOIN df USING (token), n), norm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY id),
    v AS (SELECT id, token, w / norm AS weight FROM raw JOIN norm USING (id)),
    s AS (SELECT -1 - a.id AS qid, b.id, round(sum(a.weight * b.weight), 6) AS cosine FROM v a JOIN v b USING (token) WHERE a.id < 0 AND b.id >= 0 GROUP BY ALL),
    t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, id) AS rank FROM s)"""


def tfidf_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, id, cosine, rank) of the three best over words and pairs, fitted on requests and documents together."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    words = lambda text: F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))
    best = tfidf_best(items.select(F.col("item_id").alias("qid"), "text"), docs.select(F.col("doc_id").alias("id"), "text"), words, 3)
    return r.top_k(best.withColumnRenamed("score", "cosine"), 3, "cosine")


@query("o83_tfidf_topk", _TFIDF + " SELECT item_id AS qid, t.id, t.cosine, t.rank FROM benchmark LEFT JOIN (SELECT * FROM t WHERE rank <= 3 AND cosine >= 0.05) t ON t.qid = item_id")
def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best, then those of 0.05 or more; requests without one stay."""
    best = tfidf_hits(spark, sf_dir).where("cosine >= 0.05")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid")).join(best, "qid", "left")


_VECTORS = """
    WITH v AS (SELECT vec_id, embedding::double[] AS e FROM embeddings),
    s AS (SELECT a.vec_id AS qid, b.vec_id AS id, round(greatest(list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))), 0), 6) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id),
    k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s)"""


def _vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return r.vector_search(v, v, 4).where("qid <> id")


@query("o72_vector_topk", _VECTORS + " SELECT qid, id, score, rank FROM k WHERE rank <= 3")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's nearest others: with or without itself, the four best of its list hold three."""
    return r.top_k(_vectors(spark, sf_dir).drop("rank"), 3)


@query("o174_uncertainty_margin", _VECTORS + " SELECT qid, round(max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2), 6) AS margin FROM k GROUP BY qid")
def uncertainty_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = r.top_k(_vectors(spark, sf_dir).drop("rank"), 2)
    return fusion.margins(best, "score", "rank").withColumn("margin", F.round("margin", 6))


_FUSED = (
    _BASE
    + _COVERAGE
    + _BM25
    + """,
    ck AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM cov) WHERE rank <= 20),
    u AS (SELECT qid, id, 'keyword' AS s, score FROM bmk WHERE rank <= 20 UNION ALL SELECT qid, id, 'coverage', score FROM ck),
    p0 AS (SELECT qid, id, coalesce(max(score) FILTER (s = 'keyword'), 0) AS keyword, coalesce(max(score) FILTER (s = 'coverage'), 0) AS coverage, list_sort(list(DISTINCT s)) AS matched_by FROM u GROUP BY qid, id),
    p1 AS (SELECT *, round(0.2::double * keyword + 0.3::double * coverage, 8) AS final FROM p0),
    pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final DESC, id) AS rank FROM p1) WHERE rank <= 20),
    rr AS (SELECT *, 1 / (60.0::double + row_number() OVER (PARTITION BY qid ORDER BY keyword DESC, rank)) + 1 / (60.0::double + row_number() OVER (PARTITION BY qid ORDER BY coverage DESC, rank)) AS rrf FROM pool),
    ro AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 12) DESC, rank) AS new_rank FROM rr)"""
)


def fused_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, index = requests(spark, sf_dir), indexed(spark, sf_dir)
    signals = {"keyword": index.bm25(asked, 20), "coverage": index.coverage(asked, 20)}
    rows = fusion.fuse(signals).withColumns({"fuzzy": F.lit(0.0), "embedding": F.lit(0.0)})
    return fusion.rerank_by_rank(r.top_k(rows.withColumn("final", fusion.final_score()), 20, "final"), ("keyword", "coverage"))


@query("o112_hybrid_fusion", _FUSED + " SELECT qid, id, keyword, coverage, array_to_string(matched_by, ',') AS matched_by, final, rank, round(rrf, 9) AS rrf, new_rank FROM ro")
def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused_pool(spark, sf_dir).select("qid", "id", "keyword", "coverage", F.array_join("matched_by", ",").alias("matched_by"), "final", "rank", F.round("rrf", 9).alias("rrf"), "new_rank")


@query(
    "o175_review_queue",
    _FUSED
    + ", m AS (SELECT qid, round(max(rrf) FILTER (new_rank = 1) - max(rrf) FILTER (new_rank = 2), 9) AS margin FROM ro GROUP BY qid) SELECT item_id AS qid, margin, row_number() OVER (ORDER BY margin ASC NULLS LAST, item_id) AS place FROM benchmark LEFT JOIN m ON m.qid = item_id",
)
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in order of doubt: small margins first, those without a margin last."""
    m = fusion.margins(fused_pool(spark, sf_dir)).withColumn("margin", F.round("margin", 9))
    queue = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid")).join(m, "qid", "left")
    return statistics.numbered(queue, "margin", ("qid",))


@query(
    "o190_decisions",
    _FUSED
    + """, b AS (SELECT qid, id, final FROM ro WHERE rank = 1)
    SELECT item_id AS qid, CASE WHEN final >= 0.45 THEN id END AS id, CASE WHEN final >= 0.45 THEN 'auto_accepted' WHEN final IS NULL OR final < 0.2 THEN 'auto_rejected' ELSE 'pending' END AS decision, final AS confidence,
           CASE WHEN final >= 0.45 THEN 'high' WHEN final >= 0.3 THEN 'medium' ELSE 'low' END AS class FROM benchmark LEFT JOIN b ON b.qid = item_id""",
)
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accept, reject or leave open by the best raw score; thresholds fit the two signals used here."""
    t = fusion.Thresholds(high=0.45, medium=0.30)
    best = fused_pool(spark, sf_dir).where("rank = 1").select("qid", "id", F.col("final").alias("score"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid")).join(best, "qid", "left")
    none = asked.where("false").select("qid", "id")
    return fusion.decide(asked, none, t, reject_below=0.2).withColumn("class", fusion.confidence_class(F.col("confidence"), t))


@query(
    "o191_wizard_buckets",
    _FUSED
    + """, b AS (SELECT qid, id, final FROM ro WHERE new_rank = 1)
    SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN final >= 0.45 THEN 'auto' WHEN final >= 0.2 THEN 'review' ELSE 'no_match' END AS bucket FROM benchmark LEFT JOIN b ON b.qid = item_id) GROUP BY bucket""",
)
def wizard_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets by the score of the reranked first candidate, which need not be the pool's highest."""
    first = fused_pool(spark, sf_dir).where("new_rank = 1").select("qid", "final")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid")).join(first, "qid", "left")
    bucket = F.when(F.col("final") >= 0.45, "auto").when(F.col("final") >= 0.2, "review").otherwise("no_match")
    return asked.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


_FOUR = (
    _BASE
    + _COVERAGE
    + _BM25
    + """,
    nq AS (SELECT qid, count(*) AS m FROM q GROUP BY qid), nd AS (SELECT id, count(*) AS k FROM post GROUP BY id),
    jac AS (SELECT q.qid, post.id, round(count(*) / (any_value(m) + any_value(k) - count(*))::double, 6) AS score FROM q JOIN post USING (token) JOIN nq ON nq.qid = q.qid JOIN nd ON nd.id = post.id GROUP BY q.qid, post.id),
    vec AS (SELECT item_id AS qid, doc_id AS id, round(greatest(list_inner_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_inner_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_inner_product(b.embedding::double[], b.embedding::double[]))), 0), 6) AS score
            FROM benchmark JOIN embeddings a ON a.vec_id = item_id, documents JOIN embeddings b ON b.vec_id = doc_id),
    l AS (SELECT qid, id, 'keyword' AS s, score FROM bmk WHERE rank <= 20 UNION ALL SELECT qid, id, 'coverage', score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM cov) WHERE rank <= 20
          UNION ALL SELECT qid, id, 'fuzzy', score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM jac) WHERE rank <= 20 UNION ALL SELECT qid, id, 'embedding', score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM vec) WHERE rank <= 20),
    f0 AS (SELECT qid, id, coalesce(max(score) FILTER (s = 'embedding'), 0) AS embedding, coalesce(max(score) FILTER (s = 'keyword'), 0) AS keyword, coalesce(max(score) FILTER (s = 'fuzzy'), 0) AS fuzzy, coalesce(max(score) FILTER (s = 'coverage'), 0) AS coverage, list_sort(list(DISTINCT s)) AS matched_by FROM l GROUP BY qid, id),
    f1 AS (SELECT *, round(0.3::double * embedding + 0.2::double * keyword + 0.2::double * fuzzy + 0.3::double * coverage, 8) AS final FROM f0),
    f2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final DESC, id) AS rank FROM f1) WHERE rank <= 20),
    f3 AS (SELECT *, 1 / (60.0::double + row_number() OVER (PARTITION BY qid ORDER BY keyword DESC, rank)) + 1 / (60.0::double + row_number() OVER (PARTITION BY qid ORDER BY fuzzy DESC, rank)) + 1 / (60.0::double + row_number() OVER (PARTITION BY qid ORDER BY embedding DESC, rank)) AS rrf FROM f2),
    f4 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 12) DESC, rank) AS new_rank FROM f3)"""
)


def four_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool of all four signals, reranked by keyword, fuzzy and embedding.

    The share of common words takes the place of the fuzzy ratio, which SQL lacks, and
    the vectors of equal number that of the texts' own; ``hybrid`` has both as they are.
    """
    asked, index = requests(spark, sf_dir), indexed(spark, sf_dir)
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    of = lambda name, key: v.join(table(spark, sf_dir, name).select(F.col(key).alias("id")), "id", "left_semi")
    signals = {
        "embedding": r.vector_search(of("benchmark", "item_id"), of("documents", "doc_id"), 20),
        "keyword": index.bm25(asked, 20),
        "fuzzy": index.overlap(asked, 20),
        "coverage": index.coverage(asked, 20),
    }
    return fusion.rerank_by_rank(r.top_k(fusion.fuse(signals).withColumn("final", fusion.final_score()), 20, "final"))


@query("o170_hybrid_pool", _FOUR + " SELECT qid, id, embedding, keyword, fuzzy, coverage, array_to_string(matched_by, ',') AS matched_by, final, rank, round(rrf, 9) AS rrf, new_rank FROM f4")
def hybrid_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return four_signals(spark, sf_dir).select("qid", "id", "embedding", "keyword", "fuzzy", "coverage", F.array_join("matched_by", ",").alias("matched_by"), "final", "rank", F.round("rrf", 9).alias("rrf"), "new_rank")


@query(
    "o190_batch_with_exact",
    _FOUR
    + """, b AS (SELECT item_id AS qid, f4.id, final FROM benchmark LEFT JOIN f4 ON qid = item_id AND rank = 1 UNION ALL SELECT 1000000000 + doc_id, NULL, NULL FROM documents WHERE doc_id % 100 = 0),
    e AS (SELECT 1000000000 + a.doc_id AS qid, min(b.doc_id) AS id FROM documents a JOIN documents b ON a.text = b.text WHERE a.doc_id % 100 = 0 GROUP BY 1)
    SELECT qid, coalesce(e.id, CASE WHEN final >= 0.5 THEN b.id END) AS id, CASE WHEN e.id IS NOT NULL THEN 'exact_match' WHEN final >= 0.5 THEN 'auto_accepted' WHEN coalesce(final < 0.3, true) THEN 'auto_rejected' ELSE 'pending' END AS decision, CASE WHEN e.id IS NOT NULL THEN 0.99 ELSE final END AS confidence
    FROM b LEFT JOIN e USING (qid)""",
)
def batch_with_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of the items and of requests that ask for a document by its very text; copies go to the smallest number."""
    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents").where("text is not null")
    best = four_signals(spark, sf_dir).where("rank = 1").select("qid", "id", F.col("final").alias("score"))
    copies = docs.where("doc_id % 100 = 0").select((F.col("doc_id") + 1_000_000_000).alias("qid"), F.sha2("text", 256).alias("key"))
    asked = items.select(F.col("item_id").alias("qid")).union(copies.select("qid")).join(best, "qid", "left")
    held = docs.groupBy(F.sha2("text", 256).alias("key")).agg(F.min("doc_id").alias("id"))
    exact = copies.join(held, "key").select("qid", "id")
    return fusion.decide(asked, exact, fusion.Thresholds(high=0.5), reject_below=0.3)


@query("o204_explanations")
def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused_pool(spark, sf_dir).where("new_rank <= 3").select("qid", "id", F.array_join(fusion.explain(), "; ").alias("explanation"))


@query(
    "o151_rank_fusion",
    _FUSED
    + """, l AS (SELECT qid, id, score, rank, 0 AS list FROM bmk WHERE rank <= 20 UNION ALL SELECT qid, id, score, rank, 1 FROM ck),
    f AS (SELECT qid, id, round(sum(1 / (rank + 60.0::double)), 12) AS rrf, max(score) AS raw FROM l GROUP BY qid, id)
    SELECT * FROM (SELECT qid, id, round(rrf, 9) AS rrf, least(1.0, raw) AS score, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, id) AS rank FROM f) WHERE rank <= 5""",
)
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, index = requests(spark, sf_dir), indexed(spark, sf_dir)
    one = index.bm25(asked, 20).select("qid", F.lit(0).alias("list"), "rank", "id", "score")
    two = index.coverage(asked, 20).select("qid", F.lit(1).alias("list"), "rank", "id", "score")
    lists = one.union(two).withColumns({"note": F.lit(""), "code_matched": F.lit(False)})
    return fusion.merge_ranked(lists, 5).select("qid", "id", F.round("rrf", 9).alias("rrf"), "score", "rank")
