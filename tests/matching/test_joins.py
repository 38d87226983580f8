"""Set joins, assignments in order, resumable jobs, and the embedding without a model."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermill.functions import similarity
from ledgermill.operators import analogs, catalog, embedding, setjoin
from ledgermill.operators.jobs import MatchingJob
from ledgermill.plans import texts


def sets(seed, n, words=14):
    draw = random.Random(seed)
    return [(i, draw.sample([f"w{k}" for k in range(words)], draw.randint(0, 7))) for i in range(n)]


@pytest.mark.parametrize("at_least,part", [(0.5, 5000), (0.5, 3), (0.8, 3), (1.0, 5000)])
def test_similar_sets_equal_all_pairs(spark, at_least, part):
    a, b = sets(1, 60) + [(90, None)], sets(2, 50)
    like = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if x and y else 0
    schema = "id long, set array<string>"
    got = setjoin.similar_sets(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), at_least, part).collect()
    want = {(i, j): like(x, y) for i, x in a for j, y in b if like(x, y) >= at_least}
    assert {(r["left_id"], r["right_id"]): pytest.approx(r["score"]) for r in got} == want and len(got) == len(want)
    alone = setjoin.similar_sets(spark.createDataFrame(a, schema), None, at_least, part).collect()
    assert {(r["left_id"], r["right_id"]) for r in alone} == {(i, j) for i, x in a for j, y in a if i < j and like(x, y) >= at_least}


def test_similar_names_equal_all_pairs(spark):
    draw = random.Random(4)
    words = ["стол", "столы", "детский", "bolt", "M8", "steel", "stele", "регулируемый"]
    rows = [(n, " ".join(draw.choice(words) for _ in range(draw.randint(0, 4)))) for n in range(70)] + [(80, None), (81, " ?! ")]
    names = spark.createDataFrame(rows, "id long, name string")
    classes = setjoin.name_classes(names)
    reps = classes.where("id = rep").select("id", "f")
    every = reps.select(F.col("id").alias("qid"), F.col("f").alias("g")).join(reps, F.col("qid") < F.col("id"))
    every = every.select("qid", "id", F.round(similarity.feature_similarity(F.col("g"), F.col("f")), 6).alias("score"))
    for at_least in (0.5, 0.7):
        got = sorted(map(tuple, setjoin.similar_names(names, at_least).collect()))
        assert got and got == sorted(map(tuple, every.where(F.col("score") >= at_least).collect()))
    held = {r["id"]: r["rep"] for r in classes.collect()}
    assert all(held[n] == min(m for m, b in rows if b == a) for n, a in rows if a and n < 80 and a.strip())
    with pytest.raises(ValueError):
        setjoin.similar_names(names, 0.45)


def test_assignment_equals_the_sequential_rule(spark):
    draw = random.Random(6)
    rows = []
    for g in range(5):
        for a in range(30):
            for b in draw.sample(range(25), draw.randint(0, 8)):
                rows.append((f"g{g}", g * 100 + a, (a * 7) % 31, g * 100 + b, draw.choice([0.1, 0.5, 0.9])))
    got = {(r["group"], r["a"], r["b"], r["score"]) for r in catalog.assign_greedily(spark.createDataFrame(rows, "group string, a long, pos long, b long, score double")).collect()}
    want = set()
    for g in range(5):
        taken, mine = set(), [r for r in rows if r[0] == f"g{g}"]
        for _, a in sorted({(r[2], r[1]) for r in mine}):
            for _, b, s in sorted((-r[4], r[3], r[4]) for r in mine if r[1] == a):
                if b not in taken:
                    taken.add(b)
                    want.add((f"g{g}", a, b, s))
                    break
    assert got == want
    assert catalog.assign_greedily(spark.createDataFrame([], "group string, a long, pos long, b long, score double")).collect() == []


def test_job_is_killed_and_goes_on(spark, tmp_path):
    requests = spark.createDataFrame([(n,) for n in range(23)], "qid long")
    job, turns = MatchingJob(spark, str(tmp_path / "job")).start(requests), []

    def match(batch):
        turns.append(1)
        if len(turns) == 3:
            raise KeyboardInterrupt
        return batch.select("qid", (F.col("qid") * 2).alias("id"))

    with pytest.raises(KeyboardInterrupt):
        job.run(match, 5)
    again = MatchingJob(spark, job.tables.path).start(requests)
    assert again.progress() == {"job": "job", "done": 10, "total": 23, "state": "running"}
    again.cancel()
    assert again.run(match, 5)["state"] == "cancelled" and again.results().count() == 10
    again.resume()
    assert again.run(match, 5) == {"job": "job", "done": 23, "total": 23, "state": "done"}
    assert sorted((r["qid"], r["id"], r["batch"]) for r in again.results().collect()) == [(n, 2 * n, n // 5) for n in range(23)]
    assert len(turns) == 6  # 2 + the killed one + 3


def test_reduced_rank_is_near_the_best(spark):
    draw = np.random.default_rng(8)
    dense = draw.normal(size=(60, 5)) @ draw.normal(size=(5, 40)) + 0.05 * draw.normal(size=(60, 40))
    dense[np.abs(dense) < 0.8] = 0
    cells = [(i, f"t{j}", float(dense[i, j])) for i in range(60) for j in range(40) if dense[i, j]]
    weights = spark.createDataFrame(cells, "id long, token string, weight double")
    basis, width = embedding.right_vectors(weights, 5)
    v = np.zeros((40, width))
    for r in basis.collect():
        v[int(r["token"][1:])] = r["v"]
    assert np.allclose(v.T @ v, np.eye(width), atol=1e-8)
    lost = np.linalg.norm(dense - dense @ v @ v.T)
    s = np.linalg.svd(dense, compute_uv=False)
    assert width == 5 and lost <= 1.01 * np.sqrt((s[5:] ** 2).sum())
    rows = embedding.reduce_rank(weights, 5).collect()
    assert len(rows) == 60 and all(np.linalg.norm(r["vector"]) == pytest.approx(1) for r in rows)
    assert embedding.reduce_rank(weights.limit(0), 5).collect() == []


def test_pairs_of_codes_bring_their_ratio(spark, tmp_path):
    """The ratio is worked out once for distinct codes, which meet in as many tasks as the session has."""
    spark.range(1, 40).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(1, 300).select(F.col("id").alias("p_partkey"), *[F.lit("x").alias(c) for c in ("p_name", "p_brand", "p_type")], F.lit(1.0).alias("p_retailprice")).write.parquet(f"{tmp_path}/part.parquet")
    pairs = texts.code_pairs(spark, str(tmp_path))
    assert pairs.where(F.col("ratio") != similarity.code_ratio(F.col("item_code"), F.col("code"))).count() == 0
    codes = [set(f"#{a}#"[i : i + 2] for i in range(len(a) + 1)) for a in (f"521-{100 + s % 9}-{s % 1300:04d}" for s in range(1, 40))]
    parts = [set(f"#{a}#"[i : i + 2] for i in range(len(a) + 1)) for a in (f"521-{100 + s % 7}-{s % 1300:04d}" for s in range(1, 300))]
    assert pairs.count() == sum(len(a & b) / len(a | b) >= 0.6 - 1e-9 for a in codes for b in parts)


@pytest.mark.parametrize("broadcast", [0, 10_000])
def test_pairs_of_classes_are_expanded_by_lists(spark, monkeypatch, broadcast):
    monkeypatch.setattr(setjoin, "LIST_MEMBERS", 4)
    monkeypatch.setattr(setjoin, "BROADCAST_MEMBERS", broadcast)
    asked, there = [(f"a{n % 3}", n) for n in range(31)], [(f"b{n % 5}", n) for n in range(100, 160)]
    pairs = [("a0", "b1", 0.5), ("a2", "b1", 0.6), ("a2", "b4", 0.7), ("a9", "b0", 0.8), ("a1", "b9", 0.9)]
    df = lambda rows, c: spark.createDataFrame(rows, c)
    got = setjoin.expand_pairs(df(pairs, "left_key string, right_key string, ratio double"), df(asked, "left_key string, qid long"), df(there, "right_key string, id long"))
    assert sorted(map(tuple, got.collect())) == sorted((q, i, r) for a, b, r in pairs for x, q in asked for y, i in there if (x, y) == (a, b))


@pytest.mark.parametrize("made", [texts.code_ratios, texts.list_filter])
def test_rows_of_like_codes_are_made_last(spark, made):
    """Nothing is joined, dealt, rounded or judged for each row of a pair of codes."""
    plan = made(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    last = plan[: min(plan.index(word) for word in ("Join", "Repartition"))]
    assert last.count("Generate explode") == 2 and "round(" not in last and "CASE" not in last


def test_signatures_lose_no_pair(spark):
    """Sets of many sizes, with elements by the hundred, against all pairs."""
    r = random.Random(5)
    sets = []
    for _ in range(60):
        base = r.sample(range(900), r.choice([1, 2, 9, 40, 300]))
        sets += [base, [e for e in base if r.random() < 0.9] or base, base + r.sample(range(900, 1000), 2)]
    rows = spark.createDataFrame([(i, [str(e) for e in s]) for i, s in enumerate(sets)], "id long, set array<string>")
    for least in (0.5, 0.8):
        got = {(x["left_id"], x["right_id"]) for x in setjoin.similar_sets(rows, None, least, part_sets=7).collect()}
        want = {(i, j) for j in range(len(sets)) for i in range(j) if len(set(sets[i]) & set(sets[j])) >= (least - 1e-9) * len(set(sets[i]) | set(sets[j]))}
        assert got == want


def test_copies_of_a_name_are_cleaned_once(spark):
    names = spark.createDataFrame([(i, n) for i, n in enumerate(["Red steel bolt 5", "red steel bolt 5!", "Red steel bolt 6", "", None] * 30)], "id long, name string")
    got = setjoin.similar_names(names, 0.5)
    assert [(r["qid"], r["id"]) for r in got.collect()] == [(0, 2)]


@pytest.mark.parametrize("band", [7, 20_000])
def test_nearest_assignment_equals_the_sequential_rule_and_lists_no_pairs(spark, monkeypatch, band):
    monkeypatch.setattr(analogs, "BAND", band)
    draw = random.Random(9)
    a = [(f"g{n % 3}", n, (n * 7) % 101, draw.randint(1, 6), float(draw.choice([10, 10, 40, draw.randint(1, 90)]))) for n in range(101)]
    b = [(f"g{n % 3}", n, draw.randint(1, 6), float(draw.choice([10, 10, draw.randint(1, 90)]))) for n in range(1000, 1090)]
    got = analogs.assign_nearest(spark.createDataFrame(a, "group string, a long, pos long, size int, price double"), spark.createDataFrame(b, "group string, b long, size int, price double"), 2)
    want, taken = set(), set()
    for g, n, _, size, price in sorted(a, key=lambda r: r[2]):
        open_ = [(-analogs.nearness(abs(price - p)), m) for h, m, s, p in b if h == g and m not in taken and abs(s - size) <= 2]
        if open_:
            taken.add(min(open_)[1])
            want.add((g, n, min(open_)[1]))
    assert {(r["group"], r["a"], r["b"]) for r in got.collect()} == want
    n = 1_500  # of one brand, size and price: pairs would be 2.25 million
    many = spark.range(n).select(F.lit("g").alias("group"), F.col("id").alias("a"), F.col("id").alias("pos"), F.lit(1).alias("size"), F.lit(1.0).alias("price"))
    alike = analogs.assign_nearest(many, many.select("group", F.col("a").alias("b"), "size", "price"), 2)
    assert alike.where("a = b").count() == alike.count() == n
