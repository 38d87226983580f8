import random

import numpy as np
import public_tokenizers
import tiktoken

from ledgermill.llm import bpe, packing, queries


def plain_best_fit(sizes, capacity):
    free, rows = [], 0
    for n in sorted(sizes, reverse=True):
        fits = [f for f in free if f >= n]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - n)
        else:
            rows += 1
            free.append(capacity - n)
    return rows, sorted(free)


def test_tree_equals_plain_best_fit():
    rng = random.Random(2)
    for capacity in (1, 7, 64, 100, 2048):
        sizes = [rng.randint(1, capacity) for _ in range(500)]
        at = packing.best_fit_decreasing(sizes, capacity)
        used = [0] * (max(at) + 1)
        for n, r in zip(sizes, at):
            used[r] += n
        assert max(used) <= capacity
        assert (len(used), sorted(capacity - u for u in used)) == plain_best_fit(sizes, capacity)


def rows(n=400, seed=8):
    rng = random.Random(seed)
    return [(k, [rng.randrange(50000) for _ in range(rng.choice([1, 5, 30, 64, 65, 200, 1000]))]) for k in range(n)]


def test_exact_round_trip(spark):
    given = rows()
    packed = packing.pack(spark.createDataFrame(given, "doc_id long, ids array<int>"), 64, pad=9, shards=3)
    back = {}
    for r in packing.unpack(packed).collect():
        back.setdefault(r["doc_id"], {})[r["piece"]] = r["ids"]
    assert {d: [x for k in sorted(p) for x in p[k]] for d, p in back.items()} == dict(given)
    for r in packing.with_positions(packed).collect():
        ids, place, ends = np.frombuffer(r["ids"], "<u2"), r["positions"], r["cu_seqlens"]
        assert len(ids) == 64 and r["resets"] == ends[:-1] and ends[0] == 0 and ends[-1] == r["n_tokens"] <= 64
        assert (ids[ends[-1] :] == 9).all()
        assert place == [x for a, b in zip(ends, ends[1:]) for x in range(b - a)]
    again = packing.pack(spark.createDataFrame(given, "doc_id long, ids array<int>").repartition(5), 64, pad=9, shards=3)
    assert sorted(map(str, again.collect())) == sorted(map(str, packed.collect()))
    total = sum(len(x) for _, x in given)
    assert packed.count() <= total / 64 * 1.05 + 3


def test_edge_cases(spark):
    given = [(1, None), (2, []), (3, [5]), (3, [5]), (None, [7] * 130)]
    frame = spark.createDataFrame(given, "doc_id long, ids array<int>")
    got = packing.unpack(packing.pack(frame, 64)).collect()
    assert sorted((str(r["doc_id"]), r["piece"], len(r["ids"])) for r in got) == [("3", 0, 1), ("3", 0, 1), ("None", 0, 64), ("None", 1, 64), ("None", 2, 2)]
    assert packing.pack(frame.limit(0), 64).count() == 0
    wide = packing.pack(spark.createDataFrame([(1, [70000])], "doc_id long, ids array<int>"), 8, vocabulary=100_000)
    assert packing.unpack(wide, 100_000).first()["ids"] == [70000]


def test_query_against_plain_encoding_and_packing(spark, sf_dir):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(queries.RANKS)), special_tokens={})
    want = {r["doc_id"]: library.encode_ordinary(r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op5_token_packing(spark, sf_dir).collect()
    size, back, sizes, free = queries.ROW_TOKENS, {}, {}, {}
    for r in rows:
        ids, ends = np.frombuffer(r["ids"], "<u2"), r["cu_seqlens"]
        assert len(ids) == size and ends[0] == 0 and ends[-1] == r["n_tokens"] <= size and r["resets"] == ends[:-1] and not ids[ends[-1] :].any()
        free.setdefault(r["shard"], []).append(size - ends[-1])
        for d, p, a, b in zip(r["doc_ids"], r["pieces"], ends, ends[1:]):
            back.setdefault(d, {})[p] = ids[a:b].tolist()
            sizes.setdefault(r["shard"], []).append(b - a)
    assert {d: [x for k in range(len(p)) for x in p[k]] for d, p in back.items()} == {d: x for d, x in want.items() if x}
    for shard in sizes:
        assert (len(free[shard]), sorted(free[shard])) == plain_best_fit(sizes[shard], size)
    assert len({(r["shard"], r["row"]) for r in rows}) == len(rows)
