"""Shards by histogram sort: their law, order and slots against a sorted list."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermill.llm import sharding


def law(spark, rows, shards, tolerance=0.002, df=None):
    """Checks shards of (doc_id, text) and returns {shard: bytes}."""
    df = spark.createDataFrame(rows, "doc_id long, text string") if df is None else df
    got = sharding.shard_documents(df, shards, tolerance=tolerance).collect()
    high = {r["doc_id"]: r["h"] for r in df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    assert sorted(str(r["id"]) for r in got) == sorted(str(r[0]) for r in rows)
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    for r in got:
        assert r["size"] == len(texts[r["id"]]) + 8 and r["text_crc32"] == zlib.crc32(texts[r["id"]])
    ordered = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    order = [(high[r["id"]], -(1 << 63) if r["id"] is None else r["id"]) for r in ordered]
    assert order == sorted(order)  # stretches of the order
    held = {s: [r for r in ordered if r["shard"] == s] for s in range(shards)}
    assert sum(map(len, held.values())) == len(rows)
    assert all([r["slot"] for r in rs] == list(range(len(rs))) for rs in held.values())
    sizes = {s: sum(r["size"] for r in rs) for s, rs in held.items()}
    # a border misses its goal by the tolerance or by half of the rows with the key it would fall into
    keys = {}
    for r, k in zip(ordered, order):
        keys[k] = keys.get(k, 0) + r["size"]
    total, below = sum(sizes.values()), 0
    for s in range(shards - 1):
        below += sizes[s]
        goal = total * (s + 1) // shards
        assert abs(below - goal) <= max(total / shards * tolerance, max(keys.values()) / 2) + 1
    return sizes, held


@pytest.mark.parametrize("tolerance", [0.0, 0.002, 0.05])
def test_equal_bytes(spark, tolerance):
    draw = np.random.default_rng(4)
    rows = [(n, "é" * int(draw.integers(0, 400))) for n in range(1500)] + [(5000, "x" * 30_000), (5001, None), (5002, "")]
    law(spark, rows, 24, tolerance)


def test_a_third_in_one_group(spark):
    rows = [(n, "the same text " * 20 if n % 3 == 0 else f"text {n} " * (n % 7)) for n in range(1200)]
    sizes, held = law(spark, rows, 12)
    assert max(sizes.values()) < 1.2 * min(sizes.values())
    mine = [r for s in held.values() for r in s if r["id"] % 3 == 0]
    assert len({r["shard"] for r in mine}) <= sum(r["size"] for r in mine) * 12 // sum(sizes.values()) + 2  # side by side


def test_groups_stay_whole_within_the_tolerance(spark):
    rows = [(n, f"group {n // 4} " * 9) for n in range(2000)]
    _, held = law(spark, rows, 10, tolerance=0.05)
    where = {}
    for s, rs in held.items():
        for r in rs:
            where.setdefault(r["id"] // 4, set()).add(s)
    assert all(len(s) == 1 for s in where.values())


def test_repeats_null_ids_and_other_columns(spark):
    rows = [(None, "no id"), (1, "a"), (1, "a"), (2, "b" * 500), (None, "no id")] + [(3, "thrice")] * 600
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "high", "low", "size", "shard", "piece", "place", "slot", "n", "start", "text_crc32")})
    got = sharding.shard_documents(df, 5).collect()
    assert len(got) == len(rows) and len({r["shard"] for r in got if r["id"] == 3}) == 1
    for s in range(5):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_few_and_no_rows(spark):
    law(spark, [(1, "one"), (2, None)], 24)
    law(spark, [(1, "one")], 24)
    law(spark, [(1, "one"), (2, "two")], 1)
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_reruns_and_files(spark, tmp_path):
    rows = [(n, f"text {n} " * (n % 50)) for n in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__mark", F.col("doc_id") * 2)
    one = {r["id"]: (r["shard"], r["slot"]) for r in sharding.shard_documents(df, 6).collect()}
    two = {r["id"]: (r["shard"], r["slot"]) for r in sharding.shard_documents(df.repartition(7), 6).collect()}
    assert one == two
    files = sharding.write_shards(df, str(tmp_path / "shards"), 6)
    assert {r["doc_id"]: (r["__shard"], r["__slot"]) for r in files.collect()} == one
    assert sorted((r["doc_id"], r["text"], r["__mark"]) for r in files.collect()) == [(n, t, 2 * n) for n, t in rows]
