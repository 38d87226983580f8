"""Top k in order of bounds against scoring every name."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermill.functions import similarity
from ledgermill.operators import bounded, rules

KINDS = {
    "set": (bounded.TOKEN_SET, lambda a, b: similarity.token_set_ratio(a, b) / 100, 0.0),
    "weighted": (bounded.WEIGHTED, lambda a, b: similarity.weighted_ratio(a, b) / 100, 0.0),
    "strict": (bounded.strict_name(0.55), similarity.fuzzy_name, 0.55),
    "plain": (bounded.plain_ratio(0.8), lambda a, b: 0.0 if a == b else similarity.ratio(a, b) / 100, 0.8),
    "partial": (bounded.partial(72.0), similarity.partial_ratio, 72.0),
}


def made(seed, n):
    draw = random.Random(seed)
    words = ["стол", "стул", "детский", "bolt", "M8", "steel", "x", "гайка", "long-word-1", "0,5", "ринг", "a b"]
    out = []
    for _ in range(n):
        name = " ".join(draw.choice(words) for _ in range(draw.randint(0, 5)))
        if name and draw.random() < 0.6:  # typos, also at the start of a word
            at = draw.randrange(len(name))
            name = name[:at] + draw.choice("стzx ") + name[at + draw.randint(0, 2) :]
        out.append(name)
    return out


@pytest.mark.parametrize("kind", KINDS)
def test_bounds_hold(kind):
    names = made(3, 120) + ["", " ", "   стол\tстол"]
    index = bounded.NameIndex(names)
    of, score, _ = KINDS[kind]
    for asked in made(4, 60) + ["", "  "]:
        bound = of.bound(bounded.bounds(index, asked))
        for n, name in enumerate(names):
            assert score(asked, name) <= bound[n] + 1e-9, (asked, name)


@pytest.mark.parametrize("kind", KINDS)
def test_best_equal_scoring_all(kind):
    names = sorted(set(made(7, 200)))
    index, first = bounded.NameIndex(names), np.random.default_rng(1).permutation(len(names))
    of, score, least = KINDS[kind]
    for asked in made(8, 40):
        want = sorted(((-score(asked, n), int(r)) for n, r in zip(names, first) if (score(asked, n) > 0 if of.above else score(asked, n) >= least)))[:6]
        got, _ = bounded.best(index, first, asked, bounded.bounds(index, asked), of, 6)
        assert [(-s, int(first[at])) for s, at in got] == want


def test_few_pairs_are_scored(spark):
    names = list(dict.fromkeys(made(11, 3000)))
    catalog = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    requests = catalog.where("id % 100 = 0").withColumnRenamed("id", "qid")
    hits, report = bounded.bounded_search(requests, catalog, {"set": bounded.TOKEN_SET, "strict": bounded.strict_name(0.55)}, 5, others=True, index_names=500)
    counts = {r["kind"]: (r["scored"], r["pairs"]) for r in report.collect()}
    asked = requests.select("name").distinct().count()
    assert all(pairs == asked * len(names) and scored < 0.2 * pairs for scored, pairs in counts.values()), counts
    want = {}
    for q in range(0, len(names), 100):
        scored = sorted((-similarity.fuzzy_name(names[q], n), i) for i, n in enumerate(names) if i != q)
        want[q] = [(i, -s) for s, i in scored if -s >= 0.55][:5]
    got = {q: [] for q in want}
    for r in sorted(hits.where("kind = 'strict'").collect(), key=lambda r: (-r["score"], r["id"])):
        got[r["qid"]].append((r["id"], r["score"]))
    assert got == want


def test_nothing_asked_or_held(spark):
    catalog = spark.createDataFrame([(1, "bolt"), (None, "nut")], "id long, name string")
    none = catalog.limit(0)
    for asked, held in ((none, catalog), (catalog, none)):
        hits, report = bounded.bounded_search(asked.withColumnRenamed("id", "qid"), held, {"set": bounded.TOKEN_SET}, 3)
        assert hits.collect() == [] and all(r["scored"] == 0 for r in report.collect())


def test_more_tasks_score_no_more_pairs(spark):
    names = list(dict.fromkeys(made(13, 300)))
    catalog = spark.createDataFrame([(i, n) for i, n in enumerate(names * 3)], "id long, name string")
    requests = catalog.where("id % 5 = 0").withColumnRenamed("id", "qid")
    got, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    for tasks in ("1", "12"):
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        try:
            hits, report = bounded.bounded_search(requests, catalog, {"set": bounded.TOKEN_SET}, 5)
            got.append((sorted(map(tuple, hits.collect())), report.first()["scored"]))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]
    want = sorted((-similarity.token_set_ratio(names[5], n) / 100, i) for i, n in enumerate(names * 3))[:5]
    assert sorted((-s, i) for q, i, _, s in got[0][0] if q == 5) == [(s, i) for s, i in want if s < 0]


def test_field_aware_equals_the_similarity_of_each_pair(spark):
    names = made(17, 12)
    rows = spark.createDataFrame([(a, b, 0.1 * i) for i, a in enumerate(names[:4]) for b in [*names, None]] * 3, "item_name string, name string, score double")
    blend = F.greatest("score", F.least(F.lit(1.0), 0.35 * similarity.name_similarity("item_name", "name") + 0.30 * F.col("score")))
    assert sorted(r[0] for r in rows.select(F.round(blend, 9)).collect()) == sorted(r[0] for r in rules.field_aware(rows).select(F.round("score", 9)).collect())
