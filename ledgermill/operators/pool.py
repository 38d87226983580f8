"""The best of a catalog by four signals at once, exact, in one pass over cells of bounded size.

A cell holds some thousand classes of the catalog, those of a name together, and a block
of requests, those of a name together.  Keyword and coverage come from the tokens of the
names and the weights of the requests' terms, vectors from a product of matrices; both
are exact for every pair.  Of the fuzzy ratio an upper bound is worked out in a few array
operations (``bounded``); the ratio itself is asked for in order of what a pair can still
reach, once for two names, until the k-th best is safe.  Only the k best of each request
leave a cell.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgermill.functions import similarity
from ledgermill.operators.bounded import SAME, NameIndex, bounds
from ledgermill.operators.fusion import Weights, final_score
from ledgermill.operators.retrieval import small, top_k
from ledgermill.sources.store import stored

#: Classes of the catalog and requests that meet in a cell, about, and requests of a cell at least where tasks would be idle.
SHELF_ROWS, BLOCK_ROWS, LEAST_REQUESTS = 20_000, 1_000, 32
#: Requests of one product of matrices, and names whose ratio is asked for at first.
PRODUCT_ROWS, FIRST_NAMES = 64, 16
#: Final scores are rounded to eight places.
SLACK = 2e-8


def fuzzy(asked: str, name: str) -> float:
    return max(similarity.token_set_ratio(asked, name), similarity.weighted_ratio(asked, name)) / 100


def _vectors(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a vector, their vectors as rows of a matrix)."""
    column = column.combine_chunks()
    has = np.flatnonzero(np.asarray(column.is_valid()))
    flat = np.asarray(column.take(pa.array(has)).flatten(), np.float64)
    return has, flat.reshape(len(has), len(flat) // max(len(has), 1))


def _norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(axis=1))


class _Shelf:
    """Classes (id, name, vector, tokens) in order of their ids, and their different names."""

    def __init__(self, held: pa.Table):
        held = held.sort_by("id")  # a place is as good as the id
        self.ids = held["id"].combine_chunks()
        coded = held["name"].combine_chunks().dictionary_encode()
        self.of = np.asarray(coded.indices)
        self.names = NameIndex(coded.dictionary.to_pylist())
        first = np.unique(self.of, return_index=True)[1]
        tokens = held["tokens"].combine_chunks().take(pa.array(first)).to_pylist()
        self.words = np.array([len(t) for t in tokens], np.float64)
        counts: dict[str, dict[int, int]] = {}
        for at, mine in enumerate(tokens):
            for token in mine:
                of = counts.setdefault(token, {})
                of[at] = of.get(at, 0) + 1
        self.postings = {t: (np.array(list(c)), np.array(list(c.values()), np.float64)) for t, c in counts.items()}
        self.has, self.vectors = _vectors(held["vector"])
        self.norms = _norms(self.vectors)

    def by_words(self, terms: list[dict], gain: Callable) -> tuple[np.ndarray, np.ndarray]:
        """(keyword, coverage) of a request's terms (token, keyword, coverage) with each name."""
        raw, held = np.zeros(len(self.words)), np.zeros(len(self.words))
        for term in terms:
            found = self.postings.get(term["token"])
            if found is not None:
                at, tf = found
                raw[at] += term["keyword"] * gain(tf, self.words[at])
                held[at] += term["coverage"]
        raw = np.round(raw, 6)
        return np.where(raw > 0, np.round(1 - np.exp(-np.maximum(raw, 0) / 6.0), 6), 0.0), np.round(held, 6)

    def near(self, vectors: np.ndarray) -> np.ndarray:
        """Cosines with each class, not below 0, 0 where there is no vector."""
        out = np.zeros((len(vectors), len(self.of)))
        if len(self.has):
            norm = _norms(vectors)[:, None] * self.norms
            out[:, self.has] = np.round(np.maximum(np.divide(vectors @ self.vectors.T, norm, out=np.zeros_like(norm), where=norm > 0), 0.0), 6)
        return out


class _Ratios:
    """The fuzzy ratios of one request's name with the names of a shelf: bounds, and those worked out."""

    def __init__(self, shelf: _Shelf, name: str):
        self.name, self.names = name, shelf.names.names
        n = len(self.names)
        self.value, self.known, self.most = np.zeros(n), np.full(n, not name.strip()), np.zeros(n)  # a blank request has no fuzzy hits
        if name.strip():
            of = bounds(shelf.names, name)
            self.most = np.maximum(of.token_set, of.weighted) / 100 + SAME

    def ask(self, names: np.ndarray) -> None:
        for at in names[~self.known[names]].tolist():
            self.value[at], self.known[at] = fuzzy(self.name, self.names[at]), True


def _best(of: np.ndarray, base: np.ndarray, ratios: _Ratios, weight: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the k best classes by base + weight * ratio, their totals); ties to the smaller place, nothing at 0."""
    more = FIRST_NAMES
    most = base + weight * ratios.most[of]
    while True:
        known = ratios.known[of]
        total = np.where(known, base + weight * ratios.value[of], -1.0)
        kth = np.partition(total, len(of) - k)[len(of) - k] if len(of) > k else -1.0
        open_ = np.flatnonzero(~known & (most >= kth - SLACK))
        if not len(open_):
            break
        if len(open_) > more:
            open_ = open_[np.argpartition(most[open_], len(open_) - more)[len(open_) - more :]]
        ratios.ask(np.unique(of[open_]))
        more *= 2
    total = np.round(total, 8)
    at = np.flatnonzero((total >= kth - SLACK) & (total > 0))
    at = at[np.lexsort((at, -total[at]))][:k]
    return at, total[at]


def _cell(k: int, w: Weights, gain: Callable, schema: pa.Schema):
    def run(held: pa.Table, wanted: pa.Table) -> pa.Table:
        if not held.num_rows or not wanted.num_rows:
            return schema.empty_table()
        shelf, wanted = _Shelf(held), wanted.sort_by("name")
        qids, out = wanted["qid"].combine_chunks(), []
        names = wanted["name"].to_pylist()
        edges = [i for i in range(len(names)) if not i or names[i] != names[i - 1]] + [len(names)]
        for lo, hi in zip(edges, edges[1:]):
            keyword, coverage = shelf.by_words(wanted["terms"][lo].as_py() or [], gain)
            ratios = _Ratios(shelf, names[lo])
            words = (w.keyword * keyword + w.coverage * coverage)[shelf.of]
            for start in range(lo, hi, PRODUCT_ROWS):
                part = wanted["vector"].slice(start, min(PRODUCT_ROWS, hi - start))
                has, mine = _vectors(part)
                near = np.zeros((len(part), len(shelf.of)))
                if len(has):
                    near[has] = shelf.near(mine)
                for i, embedding in enumerate(near):
                    at, _ = _best(shelf.of, words + w.embedding * embedding, ratios, w.fuzzy, k)
                    name = shelf.of[at]
                    out.append((np.full(len(at), start + i), at, embedding[at], keyword[name], ratios.value[name], coverage[name]))
        q, c, *signals = (np.concatenate(x) for x in zip(*out))
        return pa.Table.from_arrays([qids.take(pa.array(q)), shelf.ids.take(pa.array(c)), *map(pa.array, signals)], schema=schema)

    return run


def _dealt(rows: DataFrame, most: int, into: int, name: str) -> DataFrame:
    """``rows`` with a column ``name``: rows of equal names together, but those of very many in parts of about ``most``."""
    n = rows.groupBy("name").agg((F.floor(F.count(F.lit(1)) / most) + 1).cast("int").alias("parts")).where("parts > 1")
    part = F.pmod(F.xxhash64(rows.columns[0]), F.coalesce("parts", F.lit(1)))
    return rows.join(small(n, 100_000), "name", "left").withColumn(name, F.pmod(F.xxhash64("name", part), F.lit(into)).cast("int")).drop("parts")


def bounded_pool(requests: DataFrame, catalog: DataFrame, gain: Callable, k: int = 20, w: Weights = Weights()) -> DataFrame:
    """(qid, id, embedding, keyword, fuzzy, coverage, final, rank): each request's ``k`` best of the whole catalog by the blend of all four signals.

    ``requests``: (qid, name, vector, terms), terms (token, keyword, coverage) with the
    weights of the request's tokens; ``catalog``: (id, name, vector, tokens), tokens as
    often as the name has them.  ``gain(tf, words)`` is what a token's keyword weight counts
    in a name.  Equal names have equal terms and tokens; a null vector takes no part.
    Pairs without any signal are none.
    """
    spark = catalog.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = F.coalesce("name", F.lit("")).alias("name")
    there = catalog.where("id is not null").select("id", name, "vector", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
    asked = requests.where("qid is not null").select("qid", name, "vector", "terms")
    n, m = there.count(), asked.count()
    shelves = n // SHELF_ROWS + 1
    blocks = max(m // BLOCK_ROWS + 1, min(4 * tasks // shelves, m // LEAST_REQUESTS), 1)
    each = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    held = _dealt(there, SHELF_ROWS, shelves, "shelf").withColumn("block", each(blocks)).repartition(tasks, "shelf", "block")
    wanted = _dealt(asked, BLOCK_ROWS, blocks, "block").withColumn("shelf", each(shelves)).repartition(tasks, "shelf", "block")
    types = {"qid": requests.schema["qid"].dataType, "id": catalog.schema["id"].dataType}
    signals = ("embedding", "keyword", "fuzzy", "coverage")
    schema = pa.schema([(c, to_arrow_type(t)) for c, t in types.items()] + [(s, pa.float64()) for s in signals])
    found = held.groupBy("shelf", "block").cogroup(wanted.groupBy("shelf", "block")).applyInArrow(_cell(k, w, gain, schema), ", ".join([f"{c} {t.simpleString()}" for c, t in types.items()] + [f"{s} double" for s in signals]))
    return top_k(stored(found, "pool").withColumn("final", final_score(w)), k, "final")
