import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from ledgermill.llm import bpe, queries
from tests.llm.brute import sha

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_equals_the_library_on_all_documents(spark, sf_dir, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op4_byte_bpe(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = library.encode_ordinary(r["text"])
        assert got.pop(r["doc_id"]) == (len(ids), sha(" ".join(map(str, ids))), sha(r["text"]))
    assert not got


@pytest.mark.parametrize("chunk, overlap", [(40, 16), (64, 30), (200, 64)])
def test_chunks_of_any_text(spark, library, chunk, overlap):
    rng = random.Random(chunk)
    alphabet = ["a", "the", " ", "  ", "\n", "\n\n", "'s", "'", "re", "7", "12", "!", "é", "ß", "中", "\U0001f600", "　", "\t", "x" * 90, " " * 70, "'ll", "́"]
    rows = [(k, "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 400)))) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    encoded = bpe.decode(bpe.encode(docs, PATH, P.PATTERN, chunk=chunk, overlap=overlap), PATH)
    got = {r["doc_id"]: (r["ids"], bytes(r["bytes"])) for r in encoded.collect()}
    assert got == {k: (library.encode_ordinary(t), t.encode()) for k, t in rows}


def test_edge_cases(spark, library):
    long_ = "word " * 30000
    rows = [(1, None, 0), (2, "", 0), (2, "", 0), (None, "a b", 0), (3, long_, 1), (4, "z" * 90000, 1), (5, "<|endoftext|>", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(((r["doc_id"], hashlib.sha256(bytes(r["bytes"])).hexdigest(), r["ids"] == library.encode_ordinary(bytes(r["bytes"]).decode())) for r in bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH).collect()), key=str)
    assert got == sorted(((a, sha(t or ""), True) for a, t, _ in rows), key=str)
    assert bpe.decode(bpe.encode(docs.limit(0), PATH, P.PATTERN), PATH).count() == 0


def test_short_texts_are_decoded_by_the_worker_that_encodes_them(spark, library):
    texts = ["", None, "a b  c\n\n", "жёлтый 😀 " * 20, "x1 " * 400, "z" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = bpe.encode(docs, PATH, P.PATTERN, chunk=64, overlap=16, decoded="plain")
    for r in got.collect():
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == library.encode_ordinary(text) and bytes(r["plain"]) == text.encode()
    assert got.columns == ["doc_id", "ids", "plain"] and got.count() == len(texts)
    # a second worker stands beside the first only where texts are stitched
    assert got._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
