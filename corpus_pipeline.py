"""A training-data pipeline over ``documents``: five stages, each one operator of the library.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the docs of the next one.  All but the last return the
columns of ``documents``.

All stages take null and empty texts, null ids and sources, repeated rows, very long
texts, empty tables and further columns of any name; what becomes of such rows is said
at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.llm import bpe, exact_dedup, fastsketch, mixture, toxicity
from ledgermill.llm.shared import stored

#: Near duplicates share 80 % of their 5-word shingles.
NEAR_PERCENT = 80
RANKS = "byte_bpe_50k.tiktoken"


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the fitted lexicon scores 0.5 or more; all others stay, repeated rows each.

    A null text is scored as an empty one, which is clean; a null id has no label.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, runs of white space counting as one blank, the one with the smallest id stays.

    A null text equals an empty one; of repeated rows one stays.
    """
    return exact_dedup.drop_exact_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    Null texts and texts without words are like no other and stay, and so do rows without an id.
    """
    return fastsketch.drop_near_duplicates(docs, percent=NEAR_PERCENT)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as many times as the mix of sources takes them.

    Null sources are a source of their own, the last.  A text without words weighs
    nothing: it comes as often as its source allows, or not at all if no word of the
    source is wanted.  A text longer than what its source still lacks is left out.
    """
    return mixture.mixed_rows(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each row of the mix, repeats each; a null or empty text has no ids."""
    encoded = bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", toxic_documents),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mixing", mixed_sources),
    ("byte_bpe", token_ids),
]

#: The toxicity fit and the hashes of the mix have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
