"""Searches of the index against sums over all documents, before and after a change."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgermill.operators import index as indexes
from ledgermill.operators.index import SearchIndex
from ledgermill.sources.store import fresh_path, stored

WORDS = ["alpha", "bravo", "carol", "delta", "echo", "fox", "golf", "hotel"]
REQUESTS = {1: ["alpha", "delta", "delta"], 2: ["golf", "missing"], 3: ["missing"], 4: ["alpha", "bravo", "carol", "hotel", "z" * 200]}


def texts(n: int) -> dict[int, str | None]:
    found = {i: " ".join(w for j, w in enumerate(WORDS) for _ in range((i * (j + 3) + i // 7) % (j + 2))) for i in range(n)}
    return found | {n: None, n + 1: "", n + 2: found[3], n + 3: "alpha " * 3000, n + 4: "z" * 200}


def plain(held: dict[int, str | None], k: int) -> tuple[set, set]:
    docs = {i: Counter((t or "").split()) for i, t in held.items()}
    df = Counter(w for d in docs.values() for w in d)
    n, mean = len(docs), sum(sum(d.values()) for d in docs.values()) / len(docs)
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    raw, share = {}, {}
    for q, asked in REQUESTS.items():
        weight = {w: math.log(1 + n / (1 + df[w])) if w in df else math.log(1 + n) for w in asked}
        for i, d in docs.items():
            dl = sum(d.values())
            parts = [(floor if idf[w] < 0 else idf[w]) * d[w] * 2.5 / (d[w] + 1.5 * (0.25 + 0.75 * dl / mean)) for w in asked if w in d]
            raw[q, i] = round(sum(parts), 6)
            share[q, i] = round(sum(x for w, x in weight.items() if w in d) / sum(weight.values()), 6)
    best = lambda s: {(q, i, v) for q in REQUESTS for (_, i), v in sorted((x for x in s.items() if x[0][0] == q and x[1] > 0), key=lambda x: (-x[1], x[0][1]))[:k]}
    return best(raw), best(share)


@pytest.mark.parametrize(("listed", "first"), [(1_000, 2_000), (2, 5)])
def test_searches_before_and_after_a_change(spark, monkeypatch, listed, first):
    monkeypatch.setattr(indexes, "LISTED", listed)
    monkeypatch.setattr(indexes, "FIRST_POSTINGS", first)
    monkeypatch.setattr(indexes, "BLOCK", 16)
    held = texts(150)
    docs = spark.createDataFrame([*held.items(), (None, "alpha bravo")], "id long, text string")
    asked = spark.createDataFrame([(q, w, c) for q, ws in REQUESTS.items() for w, c in Counter(ws).items()], "qid long, token string, tf long")
    index = SearchIndex(spark, fresh_path(spark, "test-index")).build(docs)

    def same():
        raw, share = plain(held, 7)
        assert {(r.qid, r.id, r.raw) for r in index.bm25(asked, 7).collect()} == raw
        assert {(r.qid, r.id, r.score) for r in index.coverage(asked, 7).collect()} == share

    same()
    new = {3: "golf golf", 900: "delta missing alpha", 901: None}
    index.change(spark.createDataFrame(list(new.items()), "id long, text string"), spark.createDataFrame([(5,), (12,)], "id long"))
    held = {i: t for i, t in held.items() if i not in (5, 12)} | new
    same()


def test_scores_of_given_pairs(spark):
    held = texts(40)
    index = SearchIndex(spark, fresh_path(spark, "test-index")).build(spark.createDataFrame(list(held.items()), "id long, text string"))
    asked = spark.createDataFrame([(q, w, c) for q, ws in REQUESTS.items() for w, c in Counter(ws).items()], "qid long, token string, tf long")
    pairs = spark.createDataFrame([(q, i) for q in REQUESTS for i in held], "qid long, id long")
    share = {(q, i): v for q, i, v in plain(held, len(held))[1]}
    assert {(r.qid, r.id): r.coverage for r in index.scores(asked, pairs).collect()} == {(q, i): share.get((q, i), 0.0) for q in REQUESTS for i in held}


def test_an_empty_table_and_no_requests(spark):
    index = SearchIndex(spark, fresh_path(spark, "test-index")).build(spark.createDataFrame([], "id long, text string"))
    asked = spark.createDataFrame([(1, "alpha", 1)], "qid long, token string, tf long")
    assert index.coverage(asked).count() == 0 and index.bm25(asked).count() == 0 and index.coverage(asked.where("false")).count() == 0


def test_a_build_stores_and_deals_no_posting_twice(spark, monkeypatch):
    def never(rows, name):
        raise AssertionError(f"{name} stored beside the index")

    monkeypatch.setattr(indexes, "stored", never)
    monkeypatch.setattr(indexes, "BLOCK", 16)
    docs = spark.createDataFrame(list(texts(100).items()), "id long, text string")
    tables = SearchIndex(spark, fresh_path(spark, "test-index")).build(docs).tables
    assert {r.blocks for r in tables.read("terms").collect()} == {105 // 16 + 1}
    rows = tables.read("postings").select("token", "block").collect()
    assert len(set(rows)) == len(rows)


def test_repeated_ids_count_once(spark):
    docs = spark.createDataFrame([(1, "alpha bravo"), (1, "alpha bravo"), (2, "carol")], "id long, text string")
    index = SearchIndex(spark, fresh_path(spark, "test-index")).build(docs)
    assert index.size() == (2, 3) and {tuple(r) for r in index.document_frequency().collect()} == {("alpha", 1), ("bravo", 1), ("carol", 1)}


def test_documents_that_are_looked_up_meet_their_postings_in_their_block(spark, monkeypatch):
    monkeypatch.setattr(indexes, "BLOCK", 16)
    held = {i: f"alpha w{i % 3} v{i % 5}" for i in range(100)}
    index = SearchIndex(spark, fresh_path(spark, "test-index")).build(spark.createDataFrame(list(held.items()), "id long, text string"))
    near = spark.createDataFrame([(1, 3, 0), (1, 4, 0), (2, 4, 0), (2, 99, 0), (2, 500, 0)], "qid long, id long, segment int")
    terms = spark.createDataFrame([(1, "alpha", 1.0), (1, "w0", 2.0), (2, "v4", 4.0)], "qid long, token string, w double")
    found = index._looked_up(near, terms, lambda rows: rows, lambda tf, dl: tf / dl)
    assert sorted((r.qid, r.id, round(3 * r.part)) for r in found.collect()) == [(1, 3, 1), (1, 3, 2), (1, 4, 1), (2, 4, 4), (2, 99, 4)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(qid" not in plan  # no posting is dealt by request and document


def test_a_document_with_copies_counts_as_often(spark):
    held = {1: ("bolt steel", 3), 2: ("bolt nut nut", 1), 3: ("washer", 2), 4: ("bolt nut", 1)}
    once = spark.createDataFrame([(i, t, n) for i, (t, n) in held.items()], "id long, text string, copies long")
    each = spark.createDataFrame([(i + 10 * c, t) for i, (t, n) in held.items() for c in range(n)], "id long, text string")
    asked = spark.createDataFrame([(1, "bolt", 1), (1, "nut", 1), (2, "washer", 1)], "qid long, token string, tf long")
    few, all_ = (SearchIndex(spark, fresh_path(spark, "test-index")).build(d) for d in (once, each))
    assert few.size() == all_.size() == (7, 13)
    assert {tuple(r) for r in few.document_frequency().collect()} == {tuple(r) for r in all_.document_frequency().collect()}
    for search in (lambda i: i.bm25(asked, 9), lambda i: i.coverage(asked, 9)):
        assert {(r["qid"], r["id"], r["score"]) for r in search(few).collect()} == {(r["qid"], r["id"], r["score"]) for r in search(all_).where("id < 10").collect()}


def test_a_search_stores_no_more_than_its_answer(spark, monkeypatch):
    kept = {}

    def count(rows, name):
        found = stored(rows, name)
        kept[name] = max(kept.get(name, 0), found.count())
        return found

    monkeypatch.setattr(indexes, "BLOCK", 16)
    held = {i: f"alpha alpha w{i % 3} v{i % 5}" for i in range(300)}
    index = SearchIndex(spark, fresh_path(spark, "test-index")).build(spark.createDataFrame(list(held.items()), "id long, text string"))
    monkeypatch.setattr(indexes, "stored", count)
    asked = spark.createDataFrame([(q, w, 1) for q in (1, 2) for w in ("alpha", f"w{q}")], "qid long, token string, tf long")
    found = {(r.qid, r.id) for r in index.coverage(asked, 4).collect()}
    assert found == {(q, i) for q in (1, 2) for i in range(q, 12, 3)}
    assert max(kept.values()) <= 8  # not the documents of a threshold


def test_blocks_that_lie_in_two_splits_of_a_file(spark):
    held = {i: " ".join(f"w{(i * 7 + j * j) % 400}" for j in range(40)) for i in range(300)}
    asked = spark.createDataFrame([(q, f"w{q * 11 + j * 17}", 1) for q in range(1, 5) for j in range(20)], "qid long, token string, tf long")
    docs = spark.createDataFrame(list(held.items()), "id long, text string").coalesce(1)
    searches = lambda i: [sorted(map(tuple, s.collect())) for s in (i.bm25(asked, 9), i.coverage(asked, 9), i.overlap(asked, 9))]
    whole = searches(SearchIndex(spark, fresh_path(spark, "test-index")).build(docs))
    settings = {"parquet.block.size": "2048", "parquet.page.size.row.check.min": "10", "spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "0"}
    before = {n: spark.conf.get(n, None) for n in settings}
    try:
        for n, v in settings.items():
            spark.conf.set(n, v)
        index = SearchIndex(spark, fresh_path(spark, "test-index")).build(docs)
        splits = index.tables.read("postings").where("starts or ends").select("block", F.col("_metadata.file_block_start").alias("split")).distinct().collect()
        assert len(splits) > len({r.block for r in splits})  # some block begins in one task and ends in another
        assert searches(index) == whole
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_overlap_is_the_share_of_common_tokens(spark, monkeypatch, most):
    monkeypatch.setattr(indexes, "BLOCK", 16)
    monkeypatch.setattr(indexes, "BROADCAST_TERMS", most)
    held = texts(60)
    index = SearchIndex(spark, fresh_path(spark, "test-index")).build(spark.createDataFrame(list(held.items()), "id long, text string"))
    index.change(spark.createDataFrame([(7, "golf")], "id long, text string"), spark.createDataFrame([(i,) for i in range(9, 14)], "id long"))
    held = {i: t for i, t in held.items() if not 9 <= i < 14} | {7: "golf"}
    asked = spark.createDataFrame([(q, w, c) for q, ws in REQUESTS.items() for w, c in Counter(ws).items()], "qid long, token string, tf long")
    expected = set()
    for q, ws in REQUESTS.items():
        shares = {i: len(set(ws) & set((t or "").split())) / len(set(ws) | set((t or "").split())) for i, t in held.items()}
        expected |= {(q, i, round(v, 6)) for i, v in sorted(shares.items(), key=lambda x: (-round(x[1], 6), x[0]))[:5] if v > 0}
    assert {(r.qid, r.id, r.score) for r in index.overlap(asked, 5).collect()} == expected


def test_heuristic_rank_deals_no_text(spark):
    from ledgermill.plans.rulesets import heuristic_rank

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = heuristic_rank(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin [id" in plan and "SortMergeJoin [id" not in plan
