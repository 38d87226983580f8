"""The pool by all four signals in one pass against the signals of all pairs."""

import numpy as np
import pytest

from ledgermill.operators import fusion, pool
from ledgermill.plans.hybrid import HybridSearch

WORDS = "oak desk steel chair lamp blue red 120x60 shelf for teachers".split()


def tables(seed=4):
    draw = np.random.default_rng(seed)
    names = [" ".join(draw.choice(WORDS, draw.integers(1, 6))) for _ in range(25)] + ["", None, "zzz"]
    vector = lambda: None if draw.random() < 0.3 else draw.normal(size=4).round(3).tolist()
    # many vectors of one name, and rows of equal name and vector
    held = [(i, names[int(draw.integers(len(names)))] if i % 3 else names[0], vector()) for i in range(240)] + [(1000 + i, names[1], None) for i in range(9)]
    held += [(2000 + i, n, v) for i, n, v in held[:30]] + [(3000, "oak desk", [0.0] * 4)]
    asked = [(q, names[q % len(names)] if q % 4 else names[0], vector()) for q in range(40)] + [(q + 100, "ao" + (names[q] or ""), vector()) for q in range(9)] + [(500, "", [0.0] * 4), (501, None, None)]
    return asked, held


@pytest.mark.parametrize("rows", [13, 20_000])
def test_best_equals_the_signals_of_all_pairs_and_makes_no_lists(spark, monkeypatch, rows):
    monkeypatch.setattr(pool, "SHELF_ROWS", rows)
    monkeypatch.setattr(pool, "BLOCK_ROWS", rows)
    monkeypatch.setattr(pool, "FIRST_NAMES", 2)

    def no(*_):
        raise AssertionError("lists grow with the rows of a name")

    asked, held = tables()
    search = HybridSearch(spark, spark.createDataFrame(asked, "qid long, name string, vector array<double>"), spark.createDataFrame(held, "id long, name string, vector array<double>"))
    every = search.scores(search.requests.select("qid").crossJoin(search.catalog.select("id"))).withColumn("final", fusion.final_score()).where("final > 0")
    signals = ["embedding", "keyword", "fuzzy", "coverage"]
    want = {}
    same = lambda rows_: {(n, tuple(v) if v else None): {i for i, m, u in rows_ if (m, u) == (n, v)} for _, n, v in rows_}
    requests, classes = same(asked), same(held)
    of = {min(ids): ids for ids in classes.values()}
    for r in every.collect():
        want.setdefault(r["qid"], []).extend((-r["final"], i, *(r[s] for s in signals)) for i in of[r["id"]])
    want = {q: sorted(c)[:7] for q, c in want.items()}
    want = {q: want[min(ids)] for ids in requests.values() for q in ids if min(ids) in want}
    monkeypatch.setattr(HybridSearch, "lists", no)
    got = {}
    for r in search.best(7).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((-r["final"], r["id"], *(r[s] for s in signals)))
    assert got.keys() == want.keys()
    for q in want:
        assert [x[1] for x in got[q]] == [x[1] for x in want[q]] and np.allclose(got[q], want[q], atol=1e-9), q


def test_pool_of_nothing(spark):
    requests = spark.createDataFrame([], "qid long, name string, vector array<float>, terms array<struct<token string, keyword double, coverage double>>")
    catalog = spark.createDataFrame([], "id string, name string, vector array<float>, tokens array<string>")
    assert pool.bounded_pool(requests, catalog, lambda tf, words: tf).collect() == []
    one = spark.createDataFrame([("a", "oak desk", None, ["oak", "desk"])], catalog.schema)
    asked = spark.createDataFrame([(1, "oak", None, None), (2, " ", None, None)], requests.schema)
    assert [(r["qid"], r["id"], r["fuzzy"]) for r in pool.bounded_pool(asked, one, lambda tf, words: tf).collect()] == [(1, "a", 1.0)]
