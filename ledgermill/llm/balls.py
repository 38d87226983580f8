"""Ball k-means: clusters as balls, compared with neighbouring balls only.

A round knows the cluster each vector had in the round before.  The members of a
cluster that a task holds in a batch form a ball: the cluster's current centroid and
the largest distance to it.  Another centroid can be nearer to a member only if it
lies within twice that radius of the ball's centroid, so the others are no neighbours
and are not looked at.  Neighbours are sorted by the distance ``d`` of their centroid;
a member nearer than half the smallest ``d`` belongs to the stable core and stays
without a comparison, a member of the annulus between two halves is compared with
exactly the neighbours up to it.  Everything is worked out in integers, ties included,
so the result is that of comparing every vector with every centroid.

The vectors are written once, dealt into buckets by a row number; a round joins them
with the narrow table of the last assignment, bucketed alike, so that no vector is
moved again.  A task adds up its members per cluster; only k sums a task leave it, and
only the k centroids reach the driver.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgermill.llm.shared import shared_dir

#: Vectors in a bucket, about; more buckets than this many are not made.
BUCKET_ROWS = 250_000
MOST_BUCKETS = 50_000
#: Integer components below it have distances that 64 bits hold, four times over.
PLAIN = 1 << 26
#: Larger integer components do not occur: see ``integer_vectors``.
LARGEST = 1 << 59

_SUMS = "count long, sums array<decimal(38,0)>, inertia decimal(38,0), radius decimal(38,0), compared long"


@dataclass(frozen=True)
class Balls:
    """The outcome: ``assigned`` (id, cluster, distance, cluster_inertia, inertia) with one row a vector;
    ``centroids`` of integers; ``summary`` per cluster (count, inertia, squared radius), and per round the
    number of exact distances that were worked out."""

    assigned: DataFrame
    centroids: list[list[int]]
    summary: list[dict]
    compared: list[int]


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: float) -> DataFrame:
    """(id, v): the kept vectors with ``floor(scale * x)`` of every component.

    Null vectors, those of another length and those with a null or non-finite component
    are left out, and so are those with a component of ``LARGEST`` or more, whose squared
    distances no long could hold.  Null ids and repeated rows are kept.
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double") * F.lit(float(scale)))
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v"))
    fits = lambda x: x.isNotNull() & (F.abs(x) < F.lit(float(LARGEST)))  # noqa: E731  false for NaN, which is larger
    kept = rows.where((F.size("v") == dims) & F.forall("v", fits))
    return kept.select("id", F.transform("v", lambda x: F.floor(x)).alias("v"))


def _exact(rows: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit integers if their distances fit, else as Python's."""
    most = max([int(rows.max(initial=0)), -int(rows.min(initial=0)), *[abs(x) for c in centroids for x in c]])
    kind = np.int64 if most < PLAIN else object
    return rows.astype(kind), np.array(centroids, dtype=kind).reshape(len(centroids), -1)


def _squared(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    apart = rows - centre
    return (apart * apart).sum(axis=1)


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, distances worked out) by comparing with every centroid."""
    best, which = _squared(rows, centres[0]), np.zeros(len(rows), np.int32)
    for j in range(1, len(centres)):
        d = _squared(rows, centres[j])
        nearer = d < best
        best, which = np.where(nearer, d, best), np.where(nearer, np.int32(j), which)
    return which, best, len(rows) * len(centres)


def reassign(rows: np.ndarray, held: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, distances worked out) from the clusters ``held`` before."""
    which, best, worked = held.astype(np.int32), np.zeros(len(rows), centres.dtype), len(rows)
    for j in np.unique(held).tolist():
        members = np.flatnonzero(held == j)
        own = _squared(rows[members], centres[j])
        order = np.argsort(own, kind="stable")
        members, own = members[order], own[order]
        between = _squared(centres, centres[j])
        between[j] = -1
        near = [n for n in np.argsort(between, kind="stable").tolist() if n != j and between[n] <= 4 * own[-1]]  # a ball's neighbours
        number, least = np.full(len(members), j, np.int32), own.copy()
        reach = 4 * own
        for n in near:
            at = int(np.searchsorted(reach, between[n], "left"))  # members before it lie in an inner annulus or the core
            d = _squared(rows[members[at:]], centres[n])
            worked += len(d)
            nearer = (d < least[at:]) | ((d == least[at:]) & (n < number[at:]))
            least[at:], number[at:] = np.where(nearer, d, least[at:]), np.where(nearer, np.int32(n), number[at:])
        which[members], best[members] = number, least
    return which, best, worked


def _long(x) -> int | None:
    return int(x) if x < 1 << 63 else None


def _total(distances: np.ndarray) -> int:
    """Their exact sum."""
    small = distances.dtype == np.int64 and int(distances.max()) < 1 << 40
    return int(distances.sum()) if small else sum(map(int, distances.tolist()))


_BIG = pa.decimal128(38, 0)


def _assign(centroids: list[list[int]]):
    """Per batch of (rid, id, v, cluster before): a row per vector, and per task a row of sums for each cluster.

    A row of sums carries a ``rid`` of the task, so that it stays in the task's bucket.
    """
    k, dims = len(centroids), len(centroids[0])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, worked, inertia, radius = [0] * k, 0, [0] * k, [0] * k
        sums, some = np.zeros((k, dims), dtype=object), None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            some = batch
            rows, centres = _exact(np.asarray(batch.column(2).flatten(), np.int64).reshape(n, dims), centroids)
            held = batch.column(3)
            which, best, used = nearest(rows, centres) if held.null_count == n else reassign(rows, np.asarray(held), centres)
            worked += used
            for j in np.unique(which).tolist():
                mine = which == j
                count[j] += int(mine.sum())
                sums[j] += rows[mine].sum(axis=0).astype(object)  # the plain components of a batch add up to less than 64 bits
                inertia[j] += _total(best[mine])
                radius[j] = max(radius[j], int(best[mine].max()))
            distance = pa.array(best) if best.dtype == np.int64 else pa.array([_long(d) for d in best.tolist()], pa.int64())
            yield _rows(batch.column(0), batch.column(1), pa.array(which), distance, *[pa.nulls(n)] * 5)
        held = [j for j in range(k) if count[j]]
        if held:
            m = len(held)
            whole = pa.array([[Decimal(int(x)) for x in sums[j]] for j in held], pa.list_(_BIG))
            parts = [pa.array([Decimal(values[j]) for j in held], _BIG) for values in (inertia, radius)]
            yield _rows(pa.array([some.column(0)[0].as_py()] * m, pa.int64()), pa.nulls(m, some.column(1).type), pa.array(held, pa.int32()), pa.nulls(m), pa.array([count[j] for j in held]), whole, *parts, pa.array([worked] + [0] * (m - 1)))

    return run


def _rows(*columns: pa.Array) -> pa.RecordBatch:
    types = [pa.int64(), columns[1].type, pa.int32(), pa.int64(), pa.int64(), pa.list_(_BIG), _BIG, _BIG, pa.int64()]
    names = ["rid", "id", "cluster", "distance", "count", "sums", "inertia", "radius", "compared"]
    return pa.RecordBatch.from_arrays([c.cast(t) if pa.types.is_null(c.type) else c for c, t in zip(columns, types)], names=names)


class _Buckets:
    """Tables in the shared folder, dealt by ``rid``; the session's catalog knows them until ``close``."""

    def __init__(self, spark: SparkSession, number: int):
        self.spark, self.number, self.names = spark, number, []

    def write(self, df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """The table with its buckets, and as plain files, which outlive the entry of the catalog."""
        path = f"{shared_dir(self.spark)}/tables/{name}-{uuid.uuid4().hex}"
        self.names.append(f"scratch_{uuid.uuid4().hex}")
        df.write.format("parquet").bucketBy(self.number, "rid").option("path", path).saveAsTable(self.names[-1])
        return self.spark.table(self.names[-1]), self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # external: the files stay in the shared folder


def ball_kmeans(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64, scale: float = 1024.0, seed: str = "3:") -> Balls:
    """Clusters ``vectors`` by ``rounds`` rounds of exact integer k-means and a last assignment.

    Which rows count is said at ``integer_vectors``.  The first centroids are the ``k``
    kept vectors with the smallest sha256 of ``seed`` and the id, in that order; ids in
    decimal, null ids last, equal ids in order of their components.  With fewer vectors
    there are fewer clusters; an empty table gives no row.  A vector belongs to the
    nearest centroid, of equally near ones to the smaller number; a centroid becomes the
    floored mean of its vectors, and stays where it is without any.  Rounds after one
    that moves no centroid would change nothing and are left out.  Other columns of
    ``vectors``, whatever their names, take no part.
    """
    spark = vectors.sparkSession
    kept = integer_vectors(vectors, id_col, vector_col, dims, scale)
    seen = Observation()
    first = kept.observe(seen, F.count(F.lit(1)).alias("n")).select("v", F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256).alias("h"))
    centroids = [list(r["v"]) for r in first.orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()]
    n = seen.get["n"]
    buckets = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET_ROWS)))
    tables = _Buckets(spark, buckets)
    table, _ = tables.write(kept.withColumn("rid", F.monotonically_increasing_id()).repartition(buckets, "rid"), "vectors")
    rows = table.select("rid", "id", "v")
    schema = f"rid long, id {kept.schema['id'].dataType.simpleString()}, cluster int, distance long, {_SUMS}"
    state = plain = None
    compared, summary = [], []
    for turn in range(rounds + 1 if centroids else 0):
        if state is None:
            before = rows.withColumn("before", F.lit(None).cast("int"))
        else:
            before = rows.join(state.where("count is null").select("rid", F.col("cluster").alias("before")).hint("shuffle_hash"), "rid")
        state, plain = tables.write(before.mapInArrow(_assign(centroids), schema), "clusters")
        summary = _sums(plain, dims)
        compared.append(sum(s["compared"] for s in summary))
        moved = list(centroids)
        for s in summary:
            moved[s["cluster"]] = [x // s["count"] for x in s["sums"]]
        if turn == rounds or moved == centroids:
            break
        centroids = moved
    tables.close()
    if plain is None:
        plain = spark.createDataFrame([], schema)
    total = sum(s["inertia"] for s in summary)
    by_cluster = spark.createDataFrame([(s["cluster"], _long(s["inertia"]), _long(total)) for s in summary], "cluster int, cluster_inertia long, inertia long")
    assigned = plain.where("count is null").select("id", "cluster", "distance").join(F.broadcast(by_cluster), "cluster")  # k rows
    return Balls(assigned, centroids, summary, compared)


def _sums(state: DataFrame, dims: int) -> list[dict]:
    """Per cluster the sums over all tasks: k rows."""
    parts = state.where("count is not null")
    whole: Column = F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(dims)])
    found = parts.groupBy("cluster").agg(F.sum("count").alias("count"), whole.alias("sums"), F.sum("inertia").alias("inertia"), F.max("radius").alias("radius"), F.sum("compared").alias("compared"))
    return [{"cluster": r["cluster"], "count": r["count"], "sums": [int(x) for x in r["sums"]], "inertia": int(r["inertia"]), "radius": int(r["radius"]), "compared": r["compared"]} for r in found.collect()]


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
