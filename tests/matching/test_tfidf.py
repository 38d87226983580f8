"""The best documents by TF-IDF against plain Python, over several blocks."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgermill.operators import tfidf
from ledgermill.operators.retrieval import top_k


def brute(queries, docs, k):
    def terms(text):
        w = (text or "").split()
        return Counter(w) + Counter(zip(w, w[1:]))

    held = {("d", i): terms(t) for i, t in docs} | {("q", i): terms(t) for i, t in queries}
    df = Counter(t for c in held.values() for t in c)
    unit = {}
    for key, c in held.items():
        w = {t: n * (math.log((1 + len(held)) / (1 + df[t])) + 1) for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        unit[key] = {t: x / norm for t, x in w.items()}
    out = []
    for q, _ in queries:
        hits = [(-round(sum(x * unit["d", i].get(t, 0) for t, x in unit["q", q].items()), 6), i) for i, _ in docs]
        out += [(q, i, -s, n + 1) for n, (s, i) in enumerate(sorted(h for h in hits if h[0] < 0)[:k])]
    return sorted(out)


@pytest.mark.parametrize("size, cells", [(400, 10), (1 << 20, 4_000_000)])
def test_against_brute_force(spark, monkeypatch, size, cells):
    monkeypatch.setattr(tfidf, "BLOCK_BYTES", size)
    monkeypatch.setattr(tfidf, "CELLS", cells)
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("a b c d e f g hh ii jj kk ll mm nn".split()) for _ in range(n))
    docs = [(i, text(rng.randint(1, 30))) for i in range(80)] + [(90, None), (91, ""), (92, "once only")]
    docs += [(100 + i, docs[i][1]) for i in range(10)]
    queries = [(1, text(5)), (2, text(9)), (3, docs[4][1]), (4, None), (5, "unseen words"), (6, "")]
    best = tfidf.tfidf_best(spark.createDataFrame(queries, "qid long, text string"), spark.createDataFrame(docs, "id long, text string"), lambda t: F.regexp_extract_all(t, F.lit("[a-z]+"), F.lit(0)), 3)
    got = sorted(tuple(r) for r in top_k(best, 3).collect())
    want = brute(queries, docs, 3)
    assert [(q, i, n) for q, i, _, n in got] == [(q, i, n) for q, i, _, n in want]
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want))
