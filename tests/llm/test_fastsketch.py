import random

import numpy as np

from ledgermill.llm import fastsketch, words
from tests.llm import brute


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_every_coordinate_fills_and_estimates_similarity():
    rng = np.random.default_rng(5)
    pool = rng.integers(1, 2**63, 2000, dtype=np.uint64)
    sets = [pool[:1], pool[:3], pool[:1000], pool[100:1100]]
    got = fastsketch.fast_sketch(np.concatenate(sets), np.repeat(np.arange(4), [len(s) for s in sets]), 4, 512)
    assert (got != np.uint64(2**64 - 1)).all()
    alike = (got[2] == got[3]).mean()
    assert abs(alike - 900 / 1100) < 0.08


def test_equals_brute_force_on_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert result(fastsketch.near_duplicates(docs)) == brute.near_components(rows)


def test_large_group_of_near_copies_dealt_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(160):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((d, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute.near_components(rows)
    assert result(fastsketch.near_duplicates(docs)) == expected
    import pyarrow as pa

    for blocks in (1, 7):  # the pair kernel itself, in one block and in blocks
        found = []
        sets = [words.hash_words(np.frombuffer(t.encode(), np.uint8), np.array([0]), np.array([len(t.encode())]), True)[0] for _, t in rows]
        sets = [np.unique(words.windows(s, 5)) for s in sets]
        marks = (words.mix(fastsketch._sketches(sets)) >> np.uint64(56)).astype(np.uint8)
        for i in range(blocks):
            for j in range(i, blocks):
                mine = [k for k in range(len(rows)) if k % blocks in (i, j)]
                cols = [[0] * len(mine), [i] * len(mine), [j] * len(mine), [k % blocks for k in mine], [rows[k][0] for k in mine], [sets[k].tobytes() for k in mine], [marks[k].tobytes() for k in mine]]
                batch = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=list("abcdefg"))
                for out in fastsketch._verify(85)([batch]):
                    found += list(zip(out.column(0).to_pylist(), out.column(1).to_pylist()))
        root = {d: d for d, _ in rows}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in found:
            p, q = sorted((find(a), find(b)))
            root[q] = p
        assert {d: find(d) for d in root} == {d: c for d, (_, c) in expected.items()}


def test_blocks_of_a_hot_bucket_lose_no_pair(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(fastsketch, "BLOCK", 8)
    rng = np.random.default_rng(9)
    rows = []  # (bucket, rep, sketch), all sketches dissimilar
    for key, n in ((1, 20), (2, 8), (3, 9)):
        marks = rng.integers(0, 256, (n, fastsketch.SIZE), dtype=np.uint8)
        rows += [(key, 100 * key + d, marks[d].tobytes()) for d in range(n)]
    for step in (5, 100):  # a bucket within one batch of Arrow, or in many
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[at : at + step])], names=["key", "rep", "sketch"]) for at in range(0, len(rows), step)]
        root = {r[1]: r[1] for r in rows}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for out in fastsketch._families(0.68)(batches):
            for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
                p, q = sorted((find(a), find(b)))
                root[q] = p
        # over one block all members meet; within one block only those that pass the screen
        assert {find(100 + d) for d in range(20)} == {100}
        assert {find(200 + d) for d in range(8)} == {200 + d for d in range(8)}
        assert {find(300 + d) for d in range(9)} == {300}


def test_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n\t", None), (4, "one two", "c"), (5, "ONE\ntwo", "d"), (5, "ONE\ntwo", "d"), (None, "one two", "e"), (6, "ünï code", "f"), (7, "Ünï code", "f"), (8, "x " * 30000, "g"), (9, "x " * 30001, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in fastsketch.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False), (None, 1, None, False), (6, 1, 6, True), (7, 1, 7, True), (8, 1, 8, True), (9, 1, 8, False)], key=str)
    assert fastsketch.near_duplicates(docs.limit(0)).count() == 0
    stay = fastsketch.drop_near_duplicates(docs)
    assert stay.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in stay.collect()) == ["1", "2", "3", "4", "6", "7", "8", "None"]
