"""Fusion of retrieval signals, ranks, margins and decisions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.operators.retrieval import top_k
from ledgermill.sources.store import stored


@dataclass(frozen=True)
class Weights:
    embedding: float = 0.30
    keyword: float = 0.20
    fuzzy: float = 0.20
    coverage: float = 0.30

    def __post_init__(self):
        if abs(self.embedding + self.keyword + self.fuzzy + self.coverage - 1.0) >= 1e-9:
            raise ValueError("weights must sum to 1")


@dataclass(frozen=True)
class Thresholds:
    """``auto_select`` is open in the source of these rules and therefore a parameter."""

    high: float = 0.88
    medium: float = 0.55
    review: float = 0.20
    auto_select: float = 0.80
    pool: int = 20
    shown: int = 3
    rrf: int = 60


def fuse(signals: dict[str, DataFrame]) -> DataFrame:
    """One row per (qid, id) of any signal: a column per signal (0 where missing) and ``matched_by``."""
    rows = None
    for name, hits in signals.items():
        part = hits.select("qid", "id", F.lit(name).alias("signal"), F.col("score").cast("double").alias("score"))
        rows = part if rows is None else rows.unionByName(part)
    values = [F.coalesce(F.max(F.when(F.col("signal") == n, F.col("score"))), F.lit(0.0)).alias(n) for n in signals]
    return rows.groupBy("qid", "id").agg(*values, F.array_sort(F.collect_set("signal")).alias("matched_by"))


def final_score(w: Weights = Weights()) -> Column:
    return F.round(w.embedding * F.col("embedding") + w.keyword * F.col("keyword") + w.fuzzy * F.col("fuzzy") + w.coverage * F.col("coverage"), 8)


def threshold_pool(requests: DataFrame, lists: Callable[[DataFrame, int], dict[str, DataFrame]], scores: Callable[[DataFrame], DataFrame], k: int = 20, w: Weights = Weights(), depth: int = 20) -> tuple[DataFrame, dict[str, int]]:
    """((qid, id, the four signals, final, rank), counts): each request's ``k`` best by the blend of all four signals, none cut off.

    A threshold algorithm in rounds: ``lists(open, n)`` gives each signal's n best of the
    open requests (qid), ``scores(pairs)`` all signals of (qid, id).  No candidate that
    no list has shown can exceed the blend of the lists' last scores; a request whose
    k-th candidate reaches that is done, the others go on with lists four times as deep.
    A list with fewer than n hits ends at 0.  ``counts``: rounds, and pairs scored.
    """
    spark, open_, done, counts = requests.sparkSession, stored(requests.select("qid").distinct(), "open"), None, {"rounds": 0, "scored": 0}
    by_name = {"embedding": w.embedding, "keyword": w.keyword, "fuzzy": w.fuzzy, "coverage": w.coverage}
    while not open_.isEmpty():
        hits, ends = None, None
        for name, hit in lists(open_, depth).items():
            hit = stored(hit.select("qid", "id", "score"), "list")
            hits = hit.select("qid", "id") if hits is None else hits.union(hit.select("qid", "id"))
            last = hit.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= depth, F.min("score")).otherwise(0.0).alias("last"))
            part = last.select("qid", (F.lit(by_name[name]) * F.col("last")).alias("last"))
            ends = part if ends is None else ends.union(part)
        scored = stored(scores(stored(hits.distinct(), "hits")).withColumn("final", final_score(w)), "scored")
        pool = top_k(scored, k, "final")
        kth = pool.where(F.col("rank") == k).select("qid", F.col("final").alias("kth"))
        above = ends.groupBy("qid").agg(F.sum("last").alias("above"))
        state = stored(open_.join(kth, "qid", "left").join(above, "qid", "left").select("qid", (F.coalesce("kth", F.lit(-1.0)) > F.coalesce("above", F.lit(0.0)) + 1e-8).alias("safe"), (F.coalesce("above", F.lit(0.0)) == 0).alias("ended")), "state")
        ready = state.where("safe or ended").select("qid")
        part = pool.join(ready, "qid", "left_semi")
        done = part if done is None else done.unionByName(part)
        counts = {"rounds": counts["rounds"] + 1, "scored": counts["scored"] + scored.count()}
        open_, depth = state.where("not safe and not ended").select("qid"), depth * 4
    if done is None:
        done = spark.createDataFrame([], "qid long, id long, embedding double, keyword double, fuzzy double, coverage double, final double, rank int")
    return done, counts


def rerank_by_rank(pool: DataFrame, columns: tuple[str, ...] = ("keyword", "fuzzy", "embedding"), k: int = 60) -> DataFrame:
    """Reciprocal rank fusion within each request's pool; equal scores keep the pool's order (``rank``)."""
    parts = [1 / (F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(c), F.asc("rank"))) + F.lit(float(k))) for c in columns]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    out = pool.withColumn("rrf", total)
    return out.withColumn("new_rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("rrf", 12)), F.asc("rank"))))


def merge_ranked(lists: DataFrame, k: int, rrf: int = 60) -> DataFrame:
    """Fuses ranked lists (qid, list, rank, id, score, note, code_matched): order by reciprocal ranks, score is the best raw one."""
    g = lists.groupBy("qid", "id").agg(
        F.sum(1 / (F.col("rank") + F.lit(float(rrf)))).alias("rrf"),
        F.max("score").alias("raw"),
        F.min_by("note", F.struct(-F.col("score"), "list")).alias("note"),
        F.bool_or("code_matched").alias("code_matched"),
    )
    best = F.max("rrf").over(Window.partitionBy("qid"))
    ranked = top_k(g.withColumn("rrf", F.round("rrf", 12)), k, "rrf")
    return ranked.withColumn("score", F.least(F.lit(1.0), F.when(F.col("raw") > 0, F.col("raw")).otherwise(F.col("rrf") / best)))


def margins(ranked: DataFrame, score: str = "rrf", rank: str = "new_rank") -> DataFrame:
    """(qid, margin): the first score less the second; null with fewer than two."""
    return ranked.groupBy("qid").agg((F.max(F.when(F.col(rank) == 1, F.col(score))) - F.max(F.when(F.col(rank) == 2, F.col(score)))).alias("margin"))


def ambiguous(ranked: DataFrame, gap: float = 0.0005, score: str = "rrf", rank: str = "new_rank", window: int = 3) -> DataFrame:
    """The contenders of requests whose two best are closer than ``gap``: those that a tie-breaker is asked about."""
    near = margins(ranked, score, rank).where(F.col("margin") < gap)
    return ranked.where(F.col(rank) <= window).join(near, "qid")


def confidence_class(score: Column, t: Thresholds = Thresholds()) -> Column:
    return F.when(score >= t.high, "high").when(score >= t.medium, "medium").otherwise("low")


def decide(best: DataFrame, exact: DataFrame, t: Thresholds = Thresholds(), reject_below: float | None = None) -> DataFrame:
    """Batch decision per request: exact match 0.99, else accept, reject or leave pending by the best score.

    ``best``: (qid, id, score), one row per request, null id without candidates; ``exact``: (qid, id).
    """
    joined = best.join(exact.select("qid", F.col("id").alias("exact_id")), "qid", "left")
    low = F.lit(False) if reject_below is None else F.coalesce(F.col("score") < reject_below, F.lit(True))
    return joined.select(
        "qid",
        F.coalesce("exact_id", F.when(F.col("score") >= t.high, F.col("id"))).alias("id"),
        F.when(F.col("exact_id").isNotNull(), "exact_match").when(F.col("score") >= t.high, "auto_accepted").when(low, "auto_rejected").otherwise("pending").alias("decision"),
        F.when(F.col("exact_id").isNotNull(), 0.99).otherwise(F.col("score")).alias("confidence"),
    )


def explain(c: str = "coverage", k: str = "keyword", f: str = "fuzzy", e: str = "embedding", by: str = "matched_by") -> Column:
    """Short statements of fact from the scores, percent rounded half to even; the sentences are fixed values."""
    pct = lambda x: F.bround(F.col(x) * 100).cast("int").cast("string")
    parts = F.array_compact(
        F.array(
            F.when(F.col(c) >= 0.99, F.lit("Covers every significant word in the request")).when(F.col(c) > 0, F.concat(F.lit("Covers "), pct(c), F.lit("% of the request's key terms"))),
            F.when(F.col(k) >= 0.95, F.lit("Exact keyword overlap")).when(F.col(k) > 0, F.concat(pct(k), F.lit("% keyword overlap"))),
            F.when(F.col(f) >= 0.95, F.lit("Near-identical product name")).when(F.col(f) > 0, F.concat(pct(f), F.lit("% fuzzy name similarity"))),
            F.when(F.col(e) > 0, F.concat(pct(e), F.lit("% semantic similarity"))),
            F.when(F.size(by) > 0, F.concat(F.lit("Found by "), F.size(by).cast("string"), F.lit(" of 3 retrieval methods ("), F.array_join(by, ", "), F.lit(")"))),
        )
    )
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("Low-confidence candidate; no strong signal from any retrieval method")))
