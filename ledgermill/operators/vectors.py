"""Exact nearest vectors by cells.

A coarse quantiser, fitted on a bounded sample, puts every unit vector into the cell of
its nearest centre.  A request looks into its nearest cells first; the k-th best there
says how far a better vector may be, and by the triangle inequality a cell can hold one
only if its centre is no further than that and the cell's radius.  Only such cells are
looked into afterwards, so the result is that of comparing with all vectors.

Cells lie on shelves of about a set number of vectors, large cells in parts on several.
A block of requests and a shelf meet in a task; a request comes there once, with the
cells that it looks into, and products of matrices leave its best.  So every row may be a
request: vectors move as often as there are blocks or shelves, not cells.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.operators.retrieval import small, top_k
from ledgermill.sources.store import stored

#: Rows of the sample for a centre, and cells at most (all centres are held by every task).
SAMPLE_ROWS, MOST_CELLS = 32, 1024
#: Vectors of a shelf and requests of a block, about, and requests of one product of matrices.
PART_ROWS, BLOCK_ROWS, PRODUCT_ROWS = 20_000, 20_000, 128
#: Cells that a request looks into first.
FIRST_CELLS = 2
#: Scores are rounded to six places; cells within a rounding of the k-th best are looked into.
SLACK = 2e-6


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _centres(sample: np.ndarray, cells: int, turns: int = 5) -> np.ndarray:
    """Spherical k-means of the sample; any centres would be correct, good ones skip more cells."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(turns):
        which = (sample @ centres.T).argmax(axis=1)
        for j in range(cells):
            mine = sample[which == j]
            if len(mine):
                centres[j] = mine.mean(axis=0)
        centres = _unit(centres)
    return centres


class VectorIndex:
    """Vectors (id, vector) of one length by cells; null vectors are left out, zero vectors have a cell of their own."""

    def __init__(self, catalog: DataFrame, cells: int | None = None):
        spark = catalog.sparkSession
        rows = catalog.where("vector is not null and id is not null").select("id", F.col("vector").cast("array<double>").alias("vector"))
        n = rows.count()
        cells = min(MOST_CELLS, max(1, int(n**0.5) // 2)) if cells is None else cells
        # a bounded sample, the same at every run
        drawn = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS * cells).select("vector").collect()
        sample = _unit(np.array([r["vector"] for r in drawn], np.float64).reshape(len(drawn), -1)) if drawn else np.zeros((0, 1))
        sample = sample[(sample * sample).sum(axis=1) > 0]
        self.centres = _centres(sample, min(cells, len(sample))) if len(sample) else np.zeros((0, sample.shape[1]))
        self.kind = rows.schema["id"].dataType.simpleString()
        placed = rows.mapInArrow(self._place(), f"id {self.kind}, vector array<double>, cell int, away double")
        self.rows = stored(placed, "cells")
        held = self.rows.groupBy("cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).collect()  # a row a cell
        self.radius = {r["cell"]: r["radius"] for r in held}
        self.sizes = {r["cell"]: r["n"] for r in held}
        self.shelves, shelf, room = {}, -1, 0  # of a cell: its first shelf and how many
        for cell, size in sorted(self.sizes.items()):
            parts = -(-size // PART_ROWS)
            if parts > 1 or room < size:
                shelf, room = shelf + 1, PART_ROWS
            self.shelves[cell] = shelf, parts
            shelf, room = shelf + parts - 1, 0 if parts > 1 else room - size
        self.parts = spark.createDataFrame([(c, *at) for c, at in self.shelves.items()], "cell int, first int, parts int")

    def _place(self):
        centres = self.centres

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                rows = _unit(_matrix(batch.column(1)))
                near = rows @ centres.T if len(centres) else np.zeros((len(rows), 1))
                cell, cosine = near.argmax(axis=1), near.max(axis=1)
                none = (rows * rows).sum(axis=1) == 0
                away = np.where(none, 0.0, np.sqrt(np.maximum(2 - 2 * cosine, 0)))
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), vectors, pa.array(np.where(none, -1, cell).astype(np.int32)), pa.array(away)], names=["id", "vector", "cell", "away"])

        return run

    def _visits(self, first: int | None):
        """Per batch of (qid, vector, least): the cells to look into by shelf; the ``first`` nearest, or all others that can hold a score from ``least``."""
        centres, cells, shelves = self.centres, sorted(c for c in self.radius if c >= 0), self.shelves
        radius, zero = np.array([self.radius[c] for c in cells]), -1 in self.radius

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                rows = _unit(_matrix(batch.column(1)))
                away = np.sqrt(np.maximum(2 - 2 * (rows @ centres[cells].T), 0)) if cells else np.zeros((len(rows), 0))
                near = np.zeros(away.shape, bool)
                np.put_along_axis(near, away.argsort(axis=1, kind="stable")[:, :FIRST_CELLS], True, axis=1)
                if first is None:
                    least = np.asarray(batch.column(2).fill_null(-1.0), np.float64)[:, None]
                    most = 1 - np.maximum(away - radius, 0) ** 2 / 2  # of a cosine in the cell
                    blank = (rows * rows).sum(axis=1, keepdims=True) == 0
                    near = ~near & ((most >= least - SLACK) | (least <= SLACK) | blank)
                q, c = np.nonzero(near)
                cell = np.array(cells, np.int32)[c]
                if first is None and zero:  # zero vectors score 0
                    more = np.flatnonzero(least[:, 0] <= SLACK)
                    q, cell = np.append(q, more), np.append(cell, np.full(len(more), -1, np.int32))
                start, parts = (np.array([shelves[c][i] for c in cell.tolist()], np.int64) for i in (0, 1))
                again = np.repeat(np.arange(len(q)), parts)
                shelf = start[again] + np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
                q, cell = q[again], cell[again]
                order = np.lexsort((shelf, q))
                q, cell, shelf = q[order], cell[order], shelf[order].astype(np.int32)
                edge = np.flatnonzero(np.append(True, (np.diff(q) != 0) | (np.diff(shelf) != 0))) if len(q) else np.array([], int)
                at = pa.array(q[edge])
                lists = pa.ListArray.from_arrays(pa.array(np.append(edge, len(q)), pa.int32()), pa.array(cell))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(shelf[edge]), lists], names=["qid", "vector", "least", "shelf", "cells"])

        return run

    def _best(self, k: int):
        """The k best of a shelf's vectors for each request of a block in the cells that it looks into; ties go to the smaller id."""

        def run(vectors: pa.Table, requests: pa.Table) -> pa.Table:
            if not vectors.num_rows or not requests.num_rows:
                return pa.table([requests["qid"].slice(0, 0), vectors["id"].slice(0, 0), pa.array([], pa.float64())], names=["qid", "id", "score"])
            vectors = vectors.sort_by("id")  # a place is as good as the id
            ids, there = vectors["id"].combine_chunks(), _matrix(vectors["vector"])
            cells, of = np.unique(np.asarray(vectors["cell"]), return_inverse=True)
            mine, lists = _unit(_matrix(requests["vector"])), requests["cells"].combine_chunks()
            least = np.asarray(requests["least"].combine_chunks().fill_null(-1.0), np.float64)
            wants = np.zeros((len(mine), len(cells)), bool)
            asked, who = np.asarray(lists.flatten()), np.repeat(np.arange(len(mine)), np.asarray(lists.value_lengths()))
            held = np.isin(asked, cells)
            wants[who[held], np.searchsorted(cells, asked[held])] = True
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

            def product(rows: np.ndarray, columns: np.ndarray, want: np.ndarray | None) -> None:
                score = mine[rows] @ (there if len(columns) == len(of) else there[columns]).T
                floor = np.where(least[rows] <= SLACK, -np.inf, least[rows] - SLACK)
                open_ = np.flatnonzero(least[rows] < 0)
                if len(open_) and len(columns) > k:
                    seen = score[open_] if want is None else np.where(want[open_][:, of[columns]], score[open_], -np.inf)
                    kth = np.partition(seen, len(columns) - k, axis=1)[:, len(columns) - k]
                    floor[open_] = np.where(kth <= SLACK, -np.inf, kth - SLACK)
                q, c = np.nonzero(score >= floor[:, None])
                if want is not None:
                    kept = want[q, of[columns[c]]]
                    q, c = q[kept], c[kept]
                found.append(first(rows[q], columns[c], np.round(np.maximum(score[q, c], 0.0), 6)))

            def first(q: np.ndarray, c: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                order = np.lexsort((c, -s, q))
                q, c, s = q[order], c[order], s[order]
                kept = np.arange(len(q)) - np.searchsorted(q, q) < k
                return q[kept], c[kept], s[kept]

            if wants.mean() < 0.5:  # few cells of a request: a product a cell
                for cell in range(len(cells)):
                    rows, columns = np.flatnonzero(wants[:, cell]), np.flatnonzero(of == cell)
                    for lo in range(0, len(rows), PRODUCT_ROWS):
                        product(rows[lo : lo + PRODUCT_ROWS], columns, None)
            else:
                for lo in range(0, len(mine), PRODUCT_ROWS):
                    rows = np.arange(lo, min(lo + PRODUCT_ROWS, len(mine)))
                    product(rows, np.arange(len(of)), wants[rows])
            if not found:
                found.append((np.array([], int), np.array([], int), np.array([])))
            q, c, s = first(*(np.concatenate(x) for x in zip(*found)))
            return pa.table([requests["qid"].combine_chunks().take(pa.array(q)), ids.take(pa.array(c)), pa.array(s)], names=["qid", "id", "score"])

        return run

    def _meet(self, visits: DataFrame, blocks: int, k: int) -> DataFrame:
        """(qid, id, score) of the best on each shelf that a request looks into."""
        asked = visits.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
        wanted = asked.select(F.col("shelf").alias("s"), F.col("block").alias("b")).distinct()
        shelf = F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        held = self.rows.join(F.broadcast(self.parts), "cell").withColumn("shelf", shelf)  # a row a cell
        held = held.join(small(wanted, 1_000_000), held["shelf"] == wanted["s"]).select("shelf", F.col("b").alias("block"), "id", "vector", "cell")
        # small tables, but long work: a fixed number of tasks
        tasks, key = int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["shelf", "block"]
        return held.repartition(tasks, *key).groupBy(*key).cogroup(asked.repartition(tasks, *key).groupBy(*key)).applyInArrow(self._best(k), f"qid {self.kind}, id {self.kind}, score double")

    def search(self, requests: DataFrame, k: int = 20) -> tuple[DataFrame, DataFrame]:
        """((qid, id, score, rank) of each request (id, vector); (cells, visited, pairs, all_pairs)).

        Scores are cosines, not below 0 and rounded to six places; ties go to the smaller
        id.  The second result has one row: visits of cells, and how many pairs were
        compared of all.  Ids of both sides have one type.
        """
        spark = requests.sparkSession
        asked = requests.where("vector is not null and id is not null").select(F.col("id").alias("qid"), F.col("vector").cast("array<double>").alias("vector"))
        n = asked.count()
        blocks = max(1, -(-n // BLOCK_ROWS))
        schema = f"qid {self.kind}, vector array<double>, least double, shelf int, cells array<int>"
        first = stored(asked.withColumn("least", F.lit(None).cast("double")).mapInArrow(self._visits(FIRST_CELLS), schema), "visits")
        near = stored(top_k(self._meet(first, blocks, k), k).drop("rank"), "near")
        kth = top_k(near, k).where(F.col("rank") == k).select("qid", F.col("score").alias("least"))
        # not stored: each request comes again for every shelf
        rest = asked.join(kth, "qid", "left").select("qid", "vector", "least").mapInArrow(self._visits(None), schema)
        found = top_k(near.unionByName(self._meet(rest, blocks, k)), k)
        sizes = spark.createDataFrame(list(self.sizes.items()), "cell int, n long")
        # a cell in parts is looked into once
        seen = first.select("qid", "cells").union(rest.select("qid", "cells")).select("qid", F.explode("cells").alias("cell")).distinct()
        seen = seen.join(F.broadcast(sizes), "cell")  # a row a cell
        return found, seen.agg(F.lit(len(self.sizes)).alias("cells"), F.count(F.lit(1)).alias("visited"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.lit(n * sum(self.sizes.values())).alias("all_pairs"))
