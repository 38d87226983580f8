import random

import pytest
from pyspark.sql import functions as F

from ledgermill.llm import rlz
from tests.llm import brute


def result(df):
    return {r[0]: tuple(r)[1:] for r in df.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()}


def test_equals_brute_force_on_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert result(rlz.remove_repeats(docs)) == brute.substring_removal([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("share", [1000, 0])
def test_passages_that_meet_at_factor_boundaries(spark, monkeypatch, share):
    monkeypatch.setattr(rlz, "HOT_SHARE", share)
    rng = random.Random(11)
    rows = []
    for d in range(300):
        w = []
        for _ in range(rng.randint(1, 6)):
            a = rng.randrange(40)
            w += [f"v{k}" for k in range(a, a + rng.randint(3, 30))]
        rows.append((d, rows[d // 2][1] if d % 10 == 3 else " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(rlz.remove_repeats(docs)) == brute.substring_removal(rows)


def test_spans_are_true_copies(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: brute.words(r["text"]) for r in docs.collect()}
    seen = 0
    for r in rlz.remove_repeats(docs).select("doc_id", "spans").collect():
        for s in r["spans"]:
            seen += 1
            assert s["ref_id"] < r["doc_id"] and s["length"] >= 13
            assert texts[r["doc_id"]][s["start"] : s["start"] + s["length"]] == texts[s["ref_id"]][s["ref_start"] : s["ref_start"] + s["length"]]
    assert seen > 50


def test_edge_cases(spark):
    same = " ".join(f"a{k}" for k in range(20))
    rows = [(1, None, 1), (2, "", 2), (3, same, 3), (4, same + "  x", 4), (4, same + "  x", 4), (None, same, 5), (5, "short text", 6), (6, "short text", 7), (7, "w " * 40000, 8), (8, "y " + "w " * 40000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long")
    got = sorted(str((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"][:12])) for r in rlz.remove_repeats(docs).collect())
    assert got == sorted(str(x) for x in [(1, 0, 0, ""), (2, 0, 0, ""), (3, 20, 0, "a0 a1 a2 a3 "), (4, 21, 20, "x"), (4, 21, 20, "x"), (None, 20, 20, ""), (5, 2, 0, "short text"), (6, 2, 0, "short text"), (7, 40000, 0, "w w w w w w "), (8, 40001, 40000, "y")])
    assert rlz.remove_repeats(docs.limit(0)).count() == 0


def test_texts_that_share_an_id(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    rows = [(1, passage + " a"), (2, "x " + passage), (2, "y y " + passage + " zz"), (None, "q " * 5 + passage), (None, passage + " r " + passage), (3, passage), (3, "none of it " * 9)]
    got = sorted(str((r["doc_id"], r["n_removed"], r["kept_text"])) for r in rlz.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = [(1, 0, passage + " a"), (2, 20, "x"), (2, 20, "y y zz"), (None, 20, "q q q q q"), (None, 40, "r"), (3, 20, ""), (3, 0, ("none of it " * 9).strip())]
    assert got == sorted(map(str, want))


def test_factors_follow_a_reference_through_an_older_copy(spark):
    w = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(w[20:40])), (2, " ".join(w)), (3, "z " + " ".join(w))]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in rlz.remove_repeats(spark.createDataFrame(rows + [(4, "a b")], "doc_id long, text string").repartition(4)).collect()}
    assert got[1] == [] and got[2] == [(20, 20, 1, 0)] and got[4] == []
    assert rlz.factors([1, 2, 3], [((5, 0), (7, 3)), ((6, 9), (7, 4)), ((5, 2), (7, 5))], 13) == [{"start": 1, "length": 15, "ref_id": 7, "ref_start": 3}]
