"""Chains of retrieval, filter, rescoring and cut, one per kind of catalog, and manual search."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.functions.similarity import jaccard
from ledgermill.functions.text import token_set
from ledgermill.operators.retrieval import top_k
from ledgermill.operators.rules import field_aware, filter_list_candidates
from ledgermill.sources.store import stored

#: Share of the cosine in the blended score, and the least score of an exact-like match.
COSINE_SHARE = 0.75
EXACT_LIKE = 0.2


def blend_tokens(rows: DataFrame) -> DataFrame:
    """Rows (cosine, need_text, catalog_text) with score and match_type: cosine blended with the overlap of the token sets.

    A null cosine (a request without a candidate) has no score and no type.
    """
    final = F.lit(COSINE_SHARE) * F.col("cosine") + F.lit(1 - COSINE_SHARE) * jaccard(token_set("need_text"), token_set("catalog_text"))
    typed = F.when(final >= EXACT_LIKE, "exact-like").when(final.isNotNull(), "related")
    return rows.withColumns({"score": F.bround(final, 4), "match_type": typed})


def resort(pool: DataFrame, by: str, retrieved: int = 20, shown: int = 3, score: str = "score") -> DataFrame:
    """The ``retrieved`` best by ``score``, put in order of ``by``, the first ``shown`` of them."""
    return top_k(top_k(pool, retrieved, score, rank="retrieved_rank"), shown, by)


def list_candidates(hits: DataFrame, code_hits: DataFrame, k: int = 5) -> DataFrame:
    """The list tool's chain: max(5k, 25) best, code matches of the whole catalog added, filtered, rescored by name, k best.

    ``hits`` and ``code_hits``: (qid, id, score, item_name, name, item_code, code); the
    latter come in with score 0.
    """
    wide = stored(top_k(hits, max(5 * k, 25), rank="wide_rank").drop("wide_rank"), "wide")
    added = code_hits.join(wide, ["qid", "id"], "left_anti").withColumn("score", F.lit(0.0)).select(*wide.columns)
    return top_k(field_aware(filter_list_candidates(wide.unionByName(added))), k)


def manual_search(pool: DataFrame, catalog: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best by raw score; ids that left the catalog (id, active) since are dropped afterwards."""
    live = catalog.where(F.coalesce("active", F.lit(True))).select("id")
    return top_k(pool, k, "final").join(live, "id", "left_semi")


def suspicious(decided: DataFrame, least: float = 0.3) -> DataFrame:
    """Automatic matches whose coverage is below ``least``."""
    return decided.where(F.col("decision").isin("auto_accepted", "exact_match") & (F.coalesce("coverage", F.lit(0.0)) < least))


def match_bucket(selected: Column, best: Column) -> Column:
    """matched (a selected score from 0.8), review (a best one from 0.7 to under 0.8), else none."""
    return F.when(selected >= 0.8, "matched").when((best >= 0.7) & (best < 0.8), "review").otherwise("none")


def break_tie(ranked: DataFrame, choices: DataFrame, nudge: float = 1e-6, score: str = "rrf", rank: str = "new_rank") -> DataFrame:
    """``ranked`` with the contender that a tie-breaker chose (qid, id) moved first; requests without a choice stay as they are."""
    chosen = choices.select("qid", F.col("id").alias("__chosen"))
    first = ranked.where(F.col(rank) == 1).select("qid", F.col(score).alias("__top"))
    known = ranked.select("qid", F.col("id").alias("__chosen"), F.col(rank).alias("__from"))
    marked = ranked.join(first, "qid", "left").join(chosen.join(known, ["qid", "__chosen"]), "qid", "left")
    mine = F.coalesce(F.col("id") == F.col("__chosen"), F.lit(False))
    moved = F.when(mine, 1).when(F.col(rank) < F.col("__from"), F.col(rank) + 1).otherwise(F.col(rank))
    return marked.withColumns({score: F.when(mine, F.col("__top") + nudge).otherwise(F.col(score)), rank: moved}).drop("__chosen", "__from", "__top")


@dataclass(frozen=True)
class Mode:
    """Which retrievers take part, and how many candidates each request keeps."""

    name: str
    codes: bool = True
    tfidf: bool = True
    fuzzy: bool = True
    embeddings: bool = True
    candidates: int = 50

    @property
    def engine(self) -> str:
        used = {"code": self.codes, "tfidf": self.tfidf, "fuzzy": self.fuzzy, "embed": self.embeddings}
        return "_".join([self.name, *(n for n, on in used.items() if on)])

    def signals(self, found: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Of the retrievers' hits by name those that the mode uses."""
        used = {"code": self.codes, "tfidf": self.tfidf, "fuzzy": self.fuzzy, "embed": self.embeddings}
        return {n: top_k(hits, self.candidates, rank="__rank").drop("__rank") for n, hits in found.items() if used.get(n)}


#: Presets; fixed values.
FAST = Mode("fast", fuzzy=False, embeddings=False, candidates=20)
BALANCED = Mode("balanced")
SEMANTIC = replace(BALANCED, name="semantic")
