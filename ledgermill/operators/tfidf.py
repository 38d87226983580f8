"""The best documents of each request by the cosine of TF-IDF vectors, fitted on both together.

Texts are dealt once into blocks of some megabytes.  Document frequencies are added up
from one row a block and term, and only those above 1 go back to the blocks that hold the
term: any other term of a block is in one text.  So no posting is shuffled; a block works
out the lengths and cosines of its own documents and gives its best ones of each request.
Terms are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.operators.retrieval import small
from ledgermill.sources.store import stored

#: Bytes of text in a block, about.
BLOCK_BYTES = 8 << 20
#: Cosines of documents times requests that a block holds at once.
CELLS = 4_000_000
#: Cosines are rounded to six places afterwards; what is closer to the k-th best stays until then.
SLACK = 2e-6


def _hashed(rows: DataFrame, words: Callable[[Column], Column], *keys: str) -> DataFrame:
    """``keys`` and the hashes of all words of a text and of its pairs of neighbours (terms)."""
    known = rows.select(*keys, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))
    n = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("w", F.lit(1), n), F.slice("w", F.lit(2), n), lambda a, b: F.xxhash64(a, b))
    return known.select(*keys, F.concat("w", pairs).alias("terms"))


def _idf(n: int, df: Column) -> Column:
    return F.log((1.0 + n) / (1 + df)) + 1


def tfidf_best(queries: DataFrame, docs: DataFrame, words: Callable[[Column], Column], k: int) -> DataFrame:
    """(qid, id, score) with the ``k`` best documents of each request and some more, of (qid, text) and (id, text).

    Terms are the ``words`` of a text and pairs of neighbours, repeated ones as often as they occur.  Weights are
    tf * (ln((1 + n) / (1 + df)) + 1) in rows of unit length; scores are rounded to six places.
    """
    both = docs.select(F.lit(False).alias("asked"), F.col("id").cast("long").alias("id"), "text").union(queries.select(F.lit(True), F.col("qid").cast("long"), "text"))
    n, size = both.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    blocks = int(size or 0) // BLOCK_BYTES + 1
    dealt = both.withColumn("block", F.pmod(F.xxhash64("asked", "id"), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    hashed = _hashed(dealt, words, "block", "asked", "id")
    # all of a block is in one task, so these counts move nothing
    once = hashed.select("block", "asked", "id", F.explode("terms").alias("h")).distinct()
    pairs = once.groupBy("block", "h").agg(F.count(F.lit(1)).alias("n"))
    counted = pairs.withColumn("df", F.sum("n").over(Window.partitionBy("h")))
    held = stored(counted.where("df > 1").select("block", "h", "df"), "frequencies")
    wanted = stored(_hashed(queries, words, "qid").select("qid", F.explode("terms").alias("h")).groupBy("qid", "h").agg(F.count(F.lit(1)).alias("tf")), "wanted")
    known = held.join(small(wanted.select("h").distinct(), 1_000_000), "h").groupBy("h").agg(F.first("df").alias("df"))
    weighed = wanted.join(known, "h", "left").withColumn("idf", _idf(n, F.coalesce("df", F.lit(1))))
    weighed = weighed.withColumn("w", F.col("tf") * F.col("idf"))
    unit = weighed.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("qid"))))
    asks = stored(unit.groupBy("h").agg(F.collect_list("qid").alias("qids"), F.collect_list("w").alias("ws")), "asks")
    # a term of one text only is found where that text is; requests hold such a term themselves, so no document does
    told = held.join(small(asks, 100_000), "h", "left").select("block", "h", _idf(n, F.col("df")).alias("idf"), "qids", "ws")
    alone = float(np.log((1.0 + n) / 2) + 1) if n else 0.0
    ours, theirs = hashed.groupBy("block"), told.repartition(blocks, "block").groupBy("block")
    near = ours.cogroup(theirs).applyInArrow(lambda mine, known: _best_of_block(mine, known, k, alone), "qid long, id long, score double")
    return near.withColumn("score", F.round("score", 6))


def _best_of_block(texts: pa.Table, known: pa.Table, k: int, alone: float) -> pa.Table:
    texts = texts.filter(pc.invert(texts["asked"])).combine_chunks()
    texts, known = texts.filter(texts["id"].is_valid()), known.combine_chunks()
    none = pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    if not texts.num_rows or not known.num_rows:
        return none
    ids, doc = np.unique(texts["id"].to_numpy(), return_inverse=True)
    lists = texts["terms"].combine_chunks()
    lengths = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
    h = lists.flatten().to_numpy()
    names, at = np.unique(h, return_inverse=True)
    # (document, term) once each, with its number of occurrences
    cell, tf = np.unique(np.repeat(doc, lengths) * len(names) + at, return_counts=True)
    doc, at = cell // max(len(names), 1), cell % max(len(names), 1)
    order = np.argsort(known["h"].to_numpy())
    place = np.searchsorted(known["h"].to_numpy()[order], names)
    place = np.minimum(place, known.num_rows - 1)
    row = order[place]
    found = known["h"].to_numpy()[row] == names
    weight = tf * np.where(found, known["idf"].to_numpy()[row], alone)[at]
    norm = np.sqrt(np.bincount(doc, weight * weight, len(ids)))
    # only terms that a request has go on
    asked = found & known["qids"].is_valid().to_numpy()[row]
    keep = asked[at]
    doc, at, weight = doc[keep], at[keep], (weight / norm[doc])[keep]
    if not len(doc):
        return none
    who = {t: (np.asarray(known["qids"][int(row[t])].as_py()), np.asarray(known["ws"][int(row[t])].as_py())) for t in np.unique(at)}
    qids = np.unique(np.concatenate([q for q, _ in who.values()]))
    who = {t: (np.searchsorted(qids, q), w) for t, (q, w) in who.items()}
    out = []
    step = max(CELLS // len(qids), 1)
    for begin in range(0, len(ids), step):
        lo, hi = np.searchsorted(doc, [begin, begin + step])  # cells are in order of the document
        sums = np.zeros((min(step, len(ids) - begin), len(qids)))
        by_term = lo + np.argsort(at[lo:hi], kind="stable")
        cuts = np.flatnonzero(np.diff(at[by_term])) + 1
        for part in np.split(by_term, cuts):
            if len(part):
                q, w = who[at[part[0]]]
                sums[(doc[part] - begin)[:, None], q] += weight[part][:, None] * w
        least = np.partition(sums, -k, axis=0)[-k] if len(sums) > k else np.zeros(len(qids))
        d, q = np.nonzero((sums > 0) & (sums >= least - SLACK))
        out.append(pa.table({"qid": qids[q], "id": ids[begin + d], "score": sums[d, q]}))
    return pa.concat_tables(out)
