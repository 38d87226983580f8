"""Exact top k by edit ratios in order of upper bounds.

No ratio of two strings can exceed what their characters allow: the longest common
subsequence is no longer than the characters they have in common, counted.  A cell
holds some thousand distinct names as an index (characters by class and count, lengths,
tokens by name) and works out the bounds of a request against all of them in a few
array operations; tokens that two names share come from the inverted index.  Names are
then scored in order of their bound until the k-th best score is safe from what
follows.  Only the k best of each index leave a cell.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgermill.functions import similarity
from ledgermill.sources.store import stored

#: Requests and names that meet in a cell: at most, at least where tasks would be idle, and about.
BLOCK_REQUESTS, LEAST_REQUESTS, INDEX_NAMES = 1_000, 32, 20_000
#: Characters fall into so many classes; a class of several characters only loosens a bound.
CLASSES = 64
#: Ratios of names up to some ten thousand characters that are not equal are further apart.
SAME = 1e-9


def _classes(name: str) -> np.ndarray:
    """How many characters of each class the name has, white space left out."""
    codes = np.frombuffer("".join(name.split()).encode("utf-32-le"), np.uint32)
    return np.bincount(codes % CLASSES, minlength=CLASSES).astype(np.int32)


class NameIndex:
    """Distinct names and what their bounds need."""

    def __init__(self, names: list[str]):
        tokens = [n.split() for n in names]
        sets = [set(t) for t in tokens]
        self.names = names
        self.chars = np.stack([_classes(n) for n in names], axis=1)  # a row per class
        self.length = np.array([len(n) for n in names], float)
        self.space = self.length - self.chars.sum(axis=0)
        self.joints = np.array([max(len(t) - 1, 0) for t in tokens], float)
        self.sorted_length = np.array([len(" ".join(t)) for t in tokens], float)
        self.own = np.array([len(s) for s in sets], float)
        self.own_length = np.array([len(" ".join(s)) for s in sets], float)
        self.postings: dict[str, list[int]] = {}
        for at, s in enumerate(sets):
            for token in s:
                self.postings.setdefault(token, []).append(at)


@dataclass(frozen=True)
class Bounds:
    """Upper bounds (0 to 100) of the ratios of one request with every name of an index."""

    plain: np.ndarray
    sort: np.ndarray
    token_set: np.ndarray
    weighted: np.ndarray
    partial: np.ndarray


def bounds(index: NameIndex, name: str) -> Bounds:
    mine, tokens = _classes(name), name.split()
    own = set(tokens)
    common = np.zeros(len(index.names))
    for c in np.flatnonzero(mine):
        common += np.minimum(index.chars[c], mine[c])
    n, n_sorted, n_own = len(name), len(" ".join(tokens)), len(" ".join(own))
    part = lambda x, y: np.where(y == 0, 100.0, np.minimum(100.0, 200.0 * x / np.maximum(y, 1)))  # noqa: E731  two empty strings are equal
    raw = common + np.minimum(index.space, n - int(mine.sum()))
    in_order = common + np.minimum(index.joints, max(len(tokens) - 1, 0))
    plain, sort = part(raw, n + index.length), part(in_order, n_sorted + index.sorted_length)
    token_set = part(common + np.minimum(index.own - 1, len(own) - 1).clip(min=0), n_own + index.own_length)
    shared, held = np.zeros(len(index.names)), np.zeros(len(index.names))
    for token in own:
        at = index.postings.get(token)
        if at:
            shared[at] += 1
            held[at] += len(token)
    some = np.flatnonzero(shared)
    both = held[some] + shared[some] - 1  # the shared tokens as one string
    token_set[some] = np.maximum(token_set[some], np.maximum(part(both, both + n_own), part(both, both + index.own_length[some])))
    token_set[some[(shared[some] == len(own)) | (shared[some] == index.own[some])]] = 100.0
    token_set[(index.own == 0) | (not own)] = 0.0
    apart = np.maximum(index.length, n) / np.maximum(np.minimum(index.length, n), 1)
    most = lambda c, short: part(np.minimum(c, short), short + np.minimum(c, short))  # noqa: E731  a window may be shorter than the string it meets
    inner = most(raw, np.minimum(index.length, n))
    tokens_inner = np.where(shared > 0, 100.0, most(in_order, np.minimum(index.own_length, n_own)))
    scale = np.where(apart < 8, 0.9, 0.6)
    near, far = 0.95 * np.maximum(sort, token_set), np.maximum(scale * inner, 0.95 * scale * tokens_inner)
    weighted = np.where((index.length == 0) | (n == 0), 0.0, np.maximum(plain, np.where(apart < 1.5, near, far)))
    return Bounds(plain, sort, token_set, weighted, inner)


@dataclass(frozen=True)
class Kind:
    """A score of two names, the least one that counts, and its upper bound."""

    score: Callable[[str, str], float]
    bound: Callable[[Bounds], np.ndarray]
    least: float = 0.0
    above: bool = False  # whether a score must exceed ``least``


TOKEN_SET = Kind(lambda a, b: similarity.token_set_ratio(a, b) / 100, lambda b: b.token_set / 100, above=True)
WEIGHTED = Kind(lambda a, b: similarity.weighted_ratio(a, b) / 100, lambda b: b.weighted / 100, above=True)


def partial(at_least: float) -> Kind:
    return Kind(lambda a, b: similarity.partial_ratio(a, b), lambda b: b.partial, at_least)


def strict_name(at_least: float) -> Kind:
    # the score is rounded to four places, which keeps the order of score and bound
    return Kind(similarity.fuzzy_name, lambda b: np.round(np.minimum(np.minimum(b.token_set, b.sort), b.weighted) / 100 + SAME, 4), at_least)


def plain_ratio(at_least: float) -> Kind:
    """The ratio of different strings; equal ones do not count."""
    return Kind(lambda a, b: 0.0 if a == b else similarity.ratio(a, b) / 100, lambda b: b.plain / 100, at_least)


def best(index: NameIndex, first: np.ndarray, name: str, of: Bounds, kind: Kind, k: int) -> tuple[list[tuple[float, int]], int]:
    """([(score, place of the name)] of the ``k`` best, ties to the smaller ``first``; names that were scored)."""
    bound = np.round(kind.bound(of), 10)
    order = np.flatnonzero(bound > kind.least - SAME if kind.above else bound >= kind.least - SAME)
    order = order[np.lexsort((first[order], -bound[order]))]
    heap: list[tuple[float, int, int]] = []
    scored = 0
    for at in order.tolist():
        if len(heap) == k:
            least, rank = heap[0][0], -heap[0][1]
            if bound[at] < least - SAME or (bound[at] <= least + SAME and first[at] > rank):
                break  # names with the same bound follow in order of ``first``
        scored += 1
        s = kind.score(name, index.names[at])
        if s < kind.least or (kind.above and s == kind.least):
            continue
        entry = (s, -int(first[at]), at)
        if len(heap) < k:
            heappush(heap, entry)
        elif entry > heap[0]:
            heapreplace(heap, entry)
    return [(s, at) for s, _, at in sorted(heap, reverse=True)], scored


def _search(kinds: dict[str, Kind], k: int, id_type: pa.DataType):
    """Of a cell of names (name, first) and requests (asked): rows (asked, kind, score, name, first), and per kind the number of names scored."""
    schema = pa.schema([("asked", pa.string()), ("kind", pa.string()), ("score", pa.float64()), ("name", pa.string()), ("first", id_type), ("scored", pa.int64())])

    def run(held: pa.Table, wanted: pa.Table) -> pa.Table:
        names, first, counts, rows = held["name"].to_pylist(), held["first"].to_pylist(), dict.fromkeys([*kinds, ""], 0), []
        if not names or not wanted.num_rows:
            return schema.empty_table()
        order = sorted(range(len(names)), key=first.__getitem__)  # ids of any type, by rank
        ranks = np.empty(len(names), np.int64)
        ranks[order] = np.arange(len(names))
        index = NameIndex(names)
        for name in wanted["asked"].to_pylist():
            of = bounds(index, name)
            for kind, function in kinds.items():
                hits, scored = best(index, ranks, name, of, function, k)
                counts[kind] += scored
                counts[""] += len(names)
                rows += ((name, kind, s, names[at], first[at], None) for s, at in hits)
        rows += ((None, kind, None, None, None, n) for kind, n in counts.items())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def bounded_search(requests: DataFrame, catalog: DataFrame, kinds: dict[str, Kind], k: int, others: bool = False, index_names: int = INDEX_NAMES) -> tuple[DataFrame, DataFrame]:
    """((qid, id, kind, score) of each request's ``k`` best ids by each kind; (kind, scored, pairs)).

    ``requests``: (qid, name), ``catalog``: (id, name), ids of one type.  Equal names are
    one; of a catalog name the smallest ids stand for it, as no other can be among the
    best.  Null names count as empty, null ids are left out; with ``others`` equal ids
    do not meet.  About ``index_names`` distinct names and up to ``BLOCK_REQUESTS``
    distinct requests meet in a cell; few names are not cut for the sake of tasks, as each
    cell scores and returns ``k`` of them, but their requests are.  Of the second result
    ``scored`` is the number of pairs whose score was worked out, ``pairs`` of all that
    were bounded.
    """
    spark = catalog.sparkSession
    name = F.coalesce("name", F.lit("")).alias("name")
    keep = k + 1 if others else k
    same = F.row_number().over(Window.partitionBy("name").orderBy("id"))
    firsts = catalog.where("id is not null").select("id", name).withColumn("n", same).where(F.col("n") <= keep)
    held = stored(firsts.groupBy("name").agg(F.array_sort(F.collect_list("id")).alias("ids")), "names")
    wanted = requests.where("qid is not null").select("qid", name)
    asked = stored(wanted.select(F.col("name").alias("asked")).distinct(), "asked")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n, m = held.count(), asked.count()
    blocks = n // index_names + 1
    chunks = max(m // BLOCK_REQUESTS + 1, min(4 * tasks // blocks, m // LEAST_REQUESTS), 1)
    cell = lambda hashed, into, other, most: [F.pmod(F.xxhash64(hashed), F.lit(into)).cast("int").alias(other), F.explode(F.sequence(F.lit(0), F.lit(most - 1)))]
    shelf = held.select(*cell("name", blocks, "block", chunks), "name", F.col("ids")[0].alias("first")).withColumnRenamed("col", "chunk").repartition(tasks, "block", "chunk")
    asking = asked.select(*cell("asked", chunks, "at", blocks), "asked").withColumnRenamed("col", "of").repartition(tasks, "of", "at")
    id_type = catalog.schema["id"].dataType
    met = shelf.groupBy("block", "chunk").cogroup(asking.groupBy("of", "at")).applyInArrow(_search(kinds, keep, to_arrow_type(id_type)), f"asked string, kind string, score double, name string, first {id_type.simpleString()}, scored long")
    found = stored(met, "hits")
    report = found.where("asked is null").groupBy("kind").agg(F.sum("scored").alias("scored"))
    pairs = report.where("kind = ''").select(F.col("scored").alias("all"))
    report = report.where("kind <> ''").crossJoin(F.broadcast(pairs)).select("kind", "scored", (F.col("all") / len(kinds)).cast("long").alias("pairs"))  # one row
    # by name first: the k + 1 best names hold the k best ids
    order = Window.partitionBy("asked", "kind").orderBy(F.desc("score"), "first")
    near = found.where("asked is not null").withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep).join(held, "name")
    peers = F.sum(F.size("ids")).over(Window.partitionBy("asked", "kind", "score"))
    better = F.sum(F.size("ids")).over(Window.partitionBy("asked", "kind").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, 0)) - peers
    ids = near.withColumn("better", better).where(F.col("better") < keep).select("asked", "kind", "score", F.explode("ids").alias("id"))
    of_name = Window.partitionBy("asked", "kind").orderBy(F.desc("score"), "id")
    ids = ids.withColumn("n", F.row_number().over(of_name)).where(F.col("n") <= keep)
    hits = wanted.join(ids, wanted["name"] == ids["asked"]).select("qid", "id", "kind", "score")
    if others:
        best_ids = Window.partitionBy("qid", "kind").orderBy(F.desc("score"), "id")
        hits = hits.where("qid <> id").withColumn("n", F.row_number().over(best_ids)).where(F.col("n") <= k).drop("n")
    return hits, report
