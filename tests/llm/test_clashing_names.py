"""Further columns of a table, whatever their names, change nothing."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgermill.llm import bpe, exact_dedup, fastsketch, mixture, queries, rlz, spotsigs, toxicity, url_rules, warc

#: Names that the operators use within.
NAMES = (
    "id key n size bucket chain cell turn text_sha256 keep_id group_size kept "  # exact_dedup
    "of u bin held since until most pick picks whole cut rest target taken times source_size row_salt facts_of c0 c1 c2 "  # mixture
    "toxic train_id doc same score predicted weight n_words total "  # toxicity
    "row k last chunk chars ids head tail start end apart parts "  # bpe
    "rep family class keys sketch n_shingles component_id node component gone __gone "  # fastsketch
    "sequence first copy_id anchors prints ref_ids spans kept_text n_removed "  # rlz
    "mark before after part low high to signatures edited near_edited near_next next_id prev_id sigs "  # spotsigs
    "token regex rule verdict host path best fits page canonical near far base found resolution source_id p c"  # url_rules, warc
).split()


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.createDataFrame([(k, f"text number {k % 5} of some words and more of the words in it " * (1 + k % 3), "s%d" % (k % 2)) for k in range(12)], "doc_id long, text string, source string")
    return base, base.select("*", *[F.lit("clash").alias(c) for c in NAMES])


def ops(spark):
    labels = spark.createDataFrame([(k, k % 2, "x") for k in range(12)], "doc_id long, toxic int, text string")
    path, pattern = public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN
    return {
        "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, labels)),
        "drop_toxic": lambda d: toxicity.drop_toxic(d, toxicity.fit(d, labels)),
        "exact": exact_dedup.exact_duplicates,
        "drop_exact": exact_dedup.drop_exact_duplicates,
        "bpe": lambda d: bpe.encode(d, path, pattern, chunk=20, overlap=10),
        "mix": mixture.mix,
        "mixed": mixture.mixed_rows,
        "spotsigs": spotsigs.compare_edited,
        "near_pairs": lambda d: spotsigs.near_pairs(d).select(F.col("a").alias("doc_id"), "b"),
        "rlz": rlz.remove_repeats,
        "near": fastsketch.near_duplicates,
        "drop_near": fastsketch.drop_near_duplicates,
    }


@pytest.mark.parametrize("name", "toxicity drop_toxic exact drop_exact bpe mix mixed spotsigs near_pairs rlz near drop_near".split())
def test_documents(spark, docs, name):
    op = ops(spark)[name]
    plain, clashing = op(docs[0]), op(docs[1])
    columns = [c for c in plain.columns if c in clashing.columns]
    assert sorted(map(str, clashing.select(*[clashing[c] for c in columns]).collect())) == sorted(map(str, plain.collect()))


def test_packing(spark):
    from ledgermill.llm import packing

    ids = spark.createDataFrame([(k, list(range(k * 3))) for k in range(9)], "doc_id long, ids array<int>")
    clashing = ids.select("*", *[F.lit("clash").alias(c) for c in "shard doc piece all_ids row n_tokens cu_seqlens".split()])
    assert sorted(map(str, packing.pack(clashing, 16).collect())) == sorted(map(str, packing.pack(ids, 16).collect()))


def test_urls_and_captures(spark):
    pages = spark.createDataFrame([(k, f"https://a.example.com/en/{k}/x?y=1", "h") for k in range(6)], "page_id long, url string, html string")
    clashing = pages.select("*", *[F.lit("clash").alias(c) for c in NAMES])
    rules = url_rules.rule_table(spark, queries.URL_RULES)
    assert sorted(map(str, url_rules.judge_urls(clashing, rules).collect())) == sorted(map(str, url_rules.judge_urls(pages, rules).collect()))
    captures = queries.captures_of_pages(pages)
    clash = captures.select("*", *[F.lit("clash").alias(c) for c in NAMES if c not in captures.columns])
    assert sorted(map(str, warc.resolve_revisits(clash).collect())) == sorted(map(str, warc.resolve_revisits(captures).collect()))


def test_pipeline_stages(spark, sf_dir, docs):
    for name, stage in corpus_pipeline.STAGES:
        plain, clashing = stage(spark, docs[0], sf_dir), stage(spark, docs[1], sf_dir)
        assert sorted(r["doc_id"] for r in clashing.select("doc_id").collect()) == sorted(r["doc_id"] for r in plain.collect()), name
