import public_tokenizers
import tiktoken

import corpus_pipeline
from ledgermill.llm import bpe, toxicity
from tests.llm import brute


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    bad = {r["doc_id"] for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    assert bad
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    one = stages["toxicity"](spark, docs, sf_dir)
    rows = {r["doc_id"]: r for r in one.collect()}
    assert one.columns == names and set(rows) == {r["doc_id"] for r in docs.collect()} - bad
    two = stages["exact_dedup"](spark, one, sf_dir)
    first = {}
    for d in sorted(rows):
        first.setdefault(brute.re.sub(r"[\x20\x09-\x0D]+", " ", rows[d]["text"]), d)
    assert two.columns == names and {r["doc_id"] for r in two.collect()} == set(first.values())
    left = [(d, rows[d]["text"]) for d in first.values()]
    three = stages["near_dedup"](spark, two, sf_dir)
    keep = {d for d, (_, c) in brute.near_components(left, corpus_pipeline.NEAR_PERCENT).items() if c == d}
    assert three.columns == names and {r["doc_id"] for r in three.collect()} == keep
    four = stages["mixing"](spark, three, sf_dir)
    mixed = four.collect()
    assert four.columns == names and {r["doc_id"] for r in mixed} <= keep
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(corpus_pipeline.RANKS)), special_tokens={})
    five = stages["byte_bpe"](spark, four, sf_dir).collect()
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in five) == sorted((r["doc_id"], tuple(library.encode_ordinary(r["text"]))) for r in mixed)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted((r["doc_id"], r["n_tokens"]) for r in five)


BASE = "one two three four five six seven eight nine ten eleven twelve "
EDGES = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t ", "en", "a", 3),
    (4, BASE * 3, "en", "a", 1),
    (4, BASE * 3, "en", "a", 1),
    (5, BASE * 3, None, None, 1),
    (6, BASE * 3 + "more", "en", "b", 9),
    (None, "no id here at all", None, "a", 3),
    (7, "long " * 50_000, "en", "b", 1),
]
KIND = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_at_the_edges(spark):
    docs, stages = spark.createDataFrame(EDGES, KIND), dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=str)
    one = stages["toxicity"](spark, docs, "/root/testdata/sf0.001")
    assert ids(one) == sorted((r[0] for r in EDGES), key=str)
    two = stages["exact_dedup"](spark, one, "")
    assert ids(two) == [1, 3, 4, 6, 7, None]  # 2 is like 1, the second 4 and 5 are like 4
    three = stages["near_dedup"](spark, two, "")
    assert ids(three) == [1, 3, 4, 7, None]
    four = stages["mixing"](spark, three, "").collect()
    assert {r["doc_id"] for r in four} <= {1, 3, 4, 7, None} and {r["doc_id"] for r in four} >= {4, None}
    five = stages["byte_bpe"](spark, spark.createDataFrame(four, KIND), "").collect()
    assert len(five) == len(four) and all(r["n_tokens"] == len(r["ids"]) for r in five)
    nulls = stages["byte_bpe"](spark, docs.where("doc_id < 3"), "").collect()
    assert [(r["n_tokens"], r["ids"]) for r in nulls] == [(0, []), (0, [])]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], KIND)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.collect() == [], name
