import pytest

from ledgermill.llm import exact_dedup as ed
from tests.llm.brute import sha


def test_directory_doubles_where_buckets_are_overfull():
    cells = {k: 1 for k in range(16)}
    assert ed.grow_directory(cells, 16, 4) == [(0, 16, 0)]
    assert ed.grow_directory(cells, 4, 4) == [(0, 4, 2), (4, 4, 2), (8, 4, 2), (12, 4, 2)]
    assert ed.grow_directory({3: 100, 12: 1}, 10, 4)[-1] == (8, 8, 1)  # only the overfull side splits
    assert ed.grow_directory({3: 100}, 10, 4)[-1][2] == 1 and (3, 1, 4) in ed.grow_directory({3: 100}, 10, 4)
    assert ed.grow_directory({}, 10, 4) == [(0, 16, 0)]
    for buckets in (ed.grow_directory({k * k % 64: k for k in range(64)}, 20, 6),):
        assert sum(n for _, n, _ in buckets) == 64 and all(a + n == b for (a, n, _), (b, _, _) in zip(buckets, buckets[1:]))


@pytest.mark.parametrize("share", [1000, 0])
def test_colliding_keys_are_chained_and_compared(spark, monkeypatch, share):
    monkeypatch.setattr(ed, "HOT_SHARE", share)
    rows = [(k, f"text {k % 50}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = ed.build_index(docs, capacity=5, key_bits=3)  # eight keys for fifty texts
    assert index.count() == 50 and index.agg({"chain": "max"}).first()[0] >= 6
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in ed.exact_duplicates(docs, capacity=5, key_bits=3).collect()}
    assert got == {k: (k % 50, 4, k < 50, sha(t)) for k, t in rows}


def test_edge_cases(spark):
    rows = [(1, None, 9), (2, "", 9), (3, " \t", 9), (4, " ", 9), (5, "a  b\n", 9), (5, "a b ", 9), (None, "x", 9), (None, "x", 9), (6, "y" * 200000, 9), (7, "A B", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in ed.exact_duplicates(docs).collect()]
    want = [(1, 1, 2, True), (2, 1, 2, False), (3, 3, 2, True), (4, 3, 2, False), (5, 5, 2, True), (5, 5, 2, False), (None, None, 2, True), (None, None, 2, False), (6, 6, 1, True), (7, 7, 1, True)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    stay = ed.drop_exact_duplicates(docs)
    assert stay.columns == docs.columns and sorted(str(r["doc_id"]) for r in stay.collect()) == ["1", "3", "5", "6", "7", "None"]
    assert ed.exact_duplicates(docs.limit(0)).count() == 0 and ed.drop_exact_duplicates(docs.limit(0)).count() == 0


def test_buckets_split_and_owners_decide(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = ed.build_index(docs).collect()
    assert len({r["bucket"] for r in index}) > 1 and max(r["chain"] for r in index) == 0
    by_key = {}
    for r in index:  # a bucket is a range of keys
        by_key.setdefault(r["bucket"], []).append(r["key"] % 2**64)
    spans = sorted((min(k), max(k)) for k in by_key.values())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert sum(r["group_size"] for r in index) == docs.count()


def test_white_space():
    for text, want in [("", ""), (" ", " "), ("\t\n", " "), ("a", "a"), (" a\r\n b\x0b", " a b "), ("a b c", "a b c"), ("\x1c a", "\x1c a")]:
        assert ed.normal(text.encode()).decode() == want
