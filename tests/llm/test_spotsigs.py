import random
import re

from pyspark.sql import functions as F

from ledgermill.llm import queries, spotsigs
from tests.llm.brute import sha


def chains(text):
    """Spot signatures as tuples, in plain Python."""
    w = [x for x in re.split(r"[^\w]+|_+", (text or "").lower()) if x]
    content = [x for x in w if x not in spotsigs.ANCHORS]
    out, seen = set(), 0
    for x in w:
        if x in spotsigs.ANCHORS:
            if seen < len(content):
                out.add((x, *content[seen : seen + spotsigs.CHAIN]))
        else:
            seen += 1
    if content:
        out.add(("^", *content[: spotsigs.CHAIN]))
    elif w:
        out.add(("^", " ".join(w)))
    return out


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def expected(rows):
    rows = sorted((k, t or "") for k, t in rows)
    out = {}
    for (k, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        out[k] = (len(t), sha(edited), round(jaccard(chains(t), chains(edited)), 9), round(jaccard(chains(t), chains(nxt)), 9))
    return out


def test_equals_brute_force_on_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = queries.op8_spotsigs(spark, sf_dir).collect()
    got = {r["doc_id"]: (r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in found}
    assert got == expected(rows)
    prints, texts = {r["doc_id"]: r["fingerprint"] for r in found}, dict(rows)
    by_text = {}
    for k, t in texts.items():
        assert by_text.setdefault(t, prints[k]) == prints[k]
    assert sum(r["near_edited"] > r["near_next"] for r in found) > 0.95 * len(found)


def test_pairs_equal_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for d in range(120):
        if d % 3 and rows:
            w = rows[rng.randrange(len(rows))][1].split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(["zeta", "the", "kappa"])
        else:
            w = [rng.choice(["the", "of", "and", f"c{rng.randrange(500)}", f"d{rng.randrange(500)}"]) for _ in range(60)]
        rows.append((d, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = {}
    for d, t in rows:
        first.setdefault(frozenset(chains(t)), d)
    sets = sorted((d, s) for s, d in first.items())
    want = {(a, b): round(jaccard(x, y), 9) for i, (a, x) in enumerate(sets) for b, y in sets[i + 1 :] if jaccard(x, y) >= 0.8}
    assert {(r["a"], r["b"]): round(r["likeness"], 9) for r in spotsigs.near_pairs(docs).collect()} == want and want


def test_edge_cases(spark):
    rows = [(3, None, 1), (1, "", 1), (7, "the of", 1), (7, "the of", 1), (None, "a word", 1), (9, "b " * 60000 + "the end", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    got = [(r["doc_id"], r["n_chars"], r["edited"][-6:]) for r in spotsigs.compare_edited(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(3, 0, ""), (1, 0, ""), (7, 6, "the ob"), (7, 6, "the ob"), (None, 6, "a wor"), (9, 120007, "a word")]))
    assert spotsigs.compare_edited(docs.limit(0)).count() == 0
    one = spotsigs.compare_edited(docs.where("doc_id = 9")).first()
    assert one["edited"] == rows[-1][1][: 120007 - 30001] + rows[-1][1][:30001] and one["near_next"] == 1.0
    empty = docs.select(F.size(spotsigs.signatures(F.col("text"))).alias("n"), "doc_id").collect()
    assert {r["doc_id"]: r["n"] for r in empty} == {3: 0, 1: 0, 7: 1, None: 2, 9: 2}
