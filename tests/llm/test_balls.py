"""Ball k-means against comparing every vector with every centroid."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermill.llm import balls


def brute(rows, k, rounds, dims, scale=1024.0, seed="3:"):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"{seed}{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in order[:k]]

    def assign():
        out = []
        for i, v in kept:
            d, j = min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
            out.append((i, j, d))
        return out

    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, c, _) in zip(kept, found) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    found = assign()
    inertia = [sum(d for _, c, d in found if c == j) for j in range(len(centroids))]
    return sorted(((i, j, d, inertia[j], sum(inertia)) for i, j, d in found), key=str), centroids


def fit(df, k, rounds, dims, **more):
    got = balls.ball_kmeans(df, "vec_id", "embedding", k, rounds, dims, **more)
    rows = sorted(((r["id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"]) for r in got.assigned.collect()), key=str)
    return rows, got


SCHEMA = "vec_id long, embedding array<double>"


def test_grouped_points(spark):
    draw = random.Random(5)
    spots = [[draw.uniform(-1, 1) for _ in range(6)] for _ in range(9)]
    rows = [(n, [x + draw.gauss(0, 0.1) for x in draw.choice(spots)]) for n in range(400)]
    got, found = fit(spark.createDataFrame(rows, SCHEMA), 7, 6, 6)
    want, centroids = brute(rows, 7, 6, 6)
    assert got == want and found.centroids == centroids
    assert all(n < 400 * 7 for n in found.compared[1:])  # fewer than all distances
    assert sum(s["count"] for s in found.summary) == 400 and all(s["radius"] == max(r[2] for r in got if r[1] == s["cluster"]) for s in found.summary)


def test_ties_and_repeats(spark):
    draw = random.Random(1)
    rows = [(n // 2, [draw.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for n in range(120)]  # a grid: many equal distances, each id twice
    got, found = fit(spark.createDataFrame(rows, SCHEMA), 5, 10, 3, scale=2.0)
    want, centroids = brute(rows, 5, 10, 3, scale=2.0)
    assert got == want and found.centroids == centroids


def test_rows_left_out_and_few_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [3.0, 4.0]), (8, []), (9, [1.0, 2.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("id", "v", "rid", "before", "cluster", "distance", "count", "h", "n", "inertia")})
    got, found = fit(df, 8, 3, 2)
    assert {r[0] for r in got} == {1, 9, None} and len(got) == 3
    assert len(found.centroids) == 3 and all(r[2] == 0 and r[4] == 0 for r in got)
    empty, none = fit(df.where("vec_id = 2"), 8, 3, 2)
    assert empty == [] and none.centroids == []
    nothing, _ = fit(df.limit(0), 8, 3, 2)
    assert nothing == []


def test_components_beyond_plain_integers(spark):
    rows = [(n, [float(2**20 * n), float(-(2**19) * n * n)]) for n in range(20)]
    got, _ = fit(spark.createDataFrame(rows, SCHEMA), 3, 4, 2)
    want, _ = brute(rows, 3, 4, 2)
    assert [r[:3] for r in got] == [(i, j, d if d < 2**63 else None) for i, j, d, _, _ in want]


@pytest.mark.parametrize("kind", [np.int64, object])
def test_reassigning_is_exact(kind):
    draw = np.random.default_rng(3)
    rows, centres = draw.integers(-6, 7, (300, 2)).astype(kind), draw.integers(-6, 7, (12, 2)).astype(kind)
    centres[3] = centres[9]  # equal centroids
    which, best, _ = balls.nearest(rows, centres)
    for held in (which, draw.integers(0, 12, 300)):
        again, least, _ = balls.reassign(rows, held, centres)
        assert (again == which).all() and (least == best).all()


def test_vectors_stay_in_their_buckets(spark, monkeypatch):
    plans = []
    write = balls._Buckets.write

    def watched(self, df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df, name)

    monkeypatch.setattr(balls._Buckets, "write", watched)
    balls.ball_kmeans(spark.createDataFrame([(n, [float(n % 7), float(n % 11)]) for n in range(200)], SCHEMA), k=4, rounds=3, dims=2)
    assert len(plans) > 2 and not any("Exchange" in p for p in plans[2:])
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("scratch_")]
