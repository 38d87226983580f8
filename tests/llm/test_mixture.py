import random

from ledgermill.llm import mixture
from tests.llm import brute


def plain_targets(sizes, total, cap=3.0):
    """Clamps one source after the other until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    fixed = {}
    while True:
        free = [s for s in order if s not in fixed]
        rest, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        above = [s for s in free if rest * weight[s] / w > cap * sizes[s]]
        if not above:
            return fixed | {s: rest * weight[s] / w for s in free}
        fixed |= {s: cap * sizes[s] for s in above}


def rows(n=3000, seed=3):
    rng = random.Random(seed)
    sources = ["b", "a", None, "ä", "z", "B"]
    return [(k, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), rng.choices(sources, [50, 20, 10, 5, 1, 14])[0]) for k in range(n)]


def test_targets_and_taken_words(spark):
    given = rows()
    docs = spark.createDataFrame(given, "doc_id long, text string, source string")
    got = mixture.mix(docs).collect()
    sizes = {}
    for _, t, s in given:
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    targets = plain_targets(sizes, sum(sizes.values()))
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["size"] == len(r["text"].split()) and r["taken"] == r["times"] * r["size"] <= 3 * r["size"]
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - targets[r["source"]]) < 1e-6
        taken[r["source"]] += r["taken"]
    assert len(got) == len(given)
    assert all(abs(taken[s] - targets[s]) <= 300 for s in sizes)  # half of the longest document would do
    again = mixture.mix(docs.repartition(9)).collect()
    assert {r["doc_id"]: r["taken"] for r in again} == {r["doc_id"]: r["taken"] for r in got}
    assert mixture.mixed_rows(docs).count() == sum(r["times"] for r in got)


def test_salted_join_gives_the_same_mix(spark, monkeypatch):
    docs = spark.createDataFrame(rows(600), "doc_id long, text string, source string")
    want = {r["doc_id"]: r["taken"] for r in mixture.mix(docs).collect()}
    monkeypatch.setattr(mixture, "BROADCAST_SOURCES", 0)
    assert {r["doc_id"]: r["taken"] for r in mixture.mix(docs).collect()} == want


def test_edge_cases(spark):
    given = [(1, None, "a", 7), (2, "", None, 7), (3, "x y", "c", 7), (3, "x y", "c", 7), (None, "long " * 40000, "d", 7)]
    docs = spark.createDataFrame(given, "doc_id long, text string, source string, size int")
    got = mixture.mix(docs).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == [("1", 0), ("2", 0), ("3", 2), ("3", 2), ("None", 40000)]
    assert all(r["target"] == 0 and r["taken"] == 0 for r in got if r["source"] in ("a", None))
    assert mixture.mix(docs.limit(0)).count() == 0 and mixture.mixed_rows(docs).columns == docs.columns
    only_empty = mixture.mix(docs.where("doc_id = 1")).collect()
    assert [(r["target"], r["taken"]) for r in only_empty] == [(0.0, 0)]


def test_taken_words_come_near_the_targets(spark, sf_dir):
    for docs in (
        spark.read.parquet(f"{sf_dir}/documents.parquet"),
        # one text of 20,000 words may stand anywhere in the order
        spark.createDataFrame([(k, " ".join(["w"] * (20_000 if k % 500 == 7 else 3 + k % 40)), f"s{k % 4}") for k in range(2000)], "doc_id long, text string, source string"),
    ):
        by_source = {}
        for r in mixture.mix(docs).select("doc_id", "source", "size", "source_size", "target", "times", "taken").collect():
            assert r["taken"] <= 3 * r["size"]
            by_source.setdefault(r["source"], []).append(r)
        for rows in by_source.values():
            target, least = rows[0]["target"], min(r["size"] for r in rows if r["size"])
            assert abs(sum(r["taken"] for r in rows) - target) <= max(0.01 * target, least)


def test_known_sizes_are_used(spark):
    docs = spark.createDataFrame([(k, "x", k % 7, "a" if k % 3 else None) for k in range(500)], "doc_id long, text string, n int, source string")
    got = mixture.mix(docs, size_col="n").collect()
    assert all(r["size"] == r["n"] for r in got) and sum(r["size"] for r in got) == sum(k % 7 for k in range(500))
