"""TF-IDF vectors of words and characters, reduced by SVD: the embedding that needs no model."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.operators.retrieval import tfidf, token_table
from ledgermill.sources.store import stored

CHAR_WEIGHT = 0.6


def word_terms(c: Column) -> Column:
    """Words and pairs of neighbours, repeats kept."""
    w = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)\b\w+\b"), F.lit(0))
    n = F.greatest(F.size(w) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(w, F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<string>")))


def char_terms(c: Column, least: int = 3, most: int = 5) -> Column:
    """Character n-grams within words padded by one blank on each side."""
    words = F.transform(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda x: x != ""), lambda x: F.concat(F.lit(" "), x, F.lit(" ")))
    grams = [F.flatten(F.transform(words, lambda x, n=n: F.when(F.length(x) <= n, F.array(x)).otherwise(F.transform(F.sequence(F.lit(1), F.length(x) - n + 1), lambda i: F.substring(x, i, F.lit(n)))))) for n in range(least, most + 1)]
    return F.transform(F.concat(*grams), lambda g: F.concat(F.lit("#"), g))


def combined(rows: DataFrame, id_col: str, text_col: str, max_terms: int = 60_000, min_df: int = 2) -> DataFrame:
    """(id, token, weight) of unit length: sublinear word TF-IDF and 0.6 of sublinear character TF-IDF.

    Of the character n-grams those in at least ``min_df`` rows count, the ``max_terms`` most frequent.
    """
    n = rows.count()
    words = tfidf(token_table(rows, id_col, word_terms(F.col(text_col))), n, sublinear=True)
    chars = token_table(rows, id_col, char_terms(F.col(text_col)))
    totals = chars.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df)
    top = totals.orderBy(F.desc("total"), "token").limit(max_terms).select("token")  # the bound of the vocabulary
    part = tfidf(chars.join(F.broadcast(top), "token"), n, sublinear=True).withColumn("weight", F.col("weight") * CHAR_WEIGHT)
    both = words.unionByName(part)
    norm = both.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return both.join(norm, "id").select("id", "token", (F.col("weight") / F.col("norm")).alias("weight"))


def _sums(rows: DataFrame, key: str, width: int) -> DataFrame:
    """(key, v): the sum of ``weight`` times the vector ``v`` over the rows of a key."""
    return rows.groupBy(key).agg(F.array(*[F.sum(F.col("v")[i] * F.col("weight")) for i in range(width)]).alias("v"))


def _gram(rows: DataFrame, width: int) -> np.ndarray:
    """The products of all columns of ``v`` with each other: width x width numbers."""
    sums = rows.agg(*[F.sum(F.col("v")[i] * F.col("v")[j]).alias(f"g{i}_{j}") for i in range(width) for j in range(i + 1)]).first()
    out = np.zeros((width, width))
    for i in range(width):
        for j in range(i + 1):
            out[i, j] = out[j, i] = sums[f"g{i}_{j}"] or 0.0
    return out


def _turned(rows: DataFrame, key: str, matrix: np.ndarray) -> DataFrame:
    """(key, v) with ``v`` times ``matrix``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.asarray(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, -1) @ matrix
            borders = pa.array(np.arange(len(v) + 1) * matrix.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(borders, pa.array(v.ravel()))], names=[key, "v"])

    return rows.select(key, "v").mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, v array<double>")


def _orthonormal(rows: DataFrame, key: str, width: int) -> tuple[DataFrame, int]:
    """Columns of ``v`` made orthonormal over all rows; those that depend on others are left out."""
    values, vectors = np.linalg.eigh(_gram(rows, width))
    kept = values > max(values.max(initial=0.0), 0.0) * 1e-12
    return _turned(rows, key, vectors[:, kept] / np.sqrt(values[kept])), int(kept.sum())


def right_vectors(weights: DataFrame, k: int, spare: int = 8, turns: int = 3) -> tuple[DataFrame, int]:
    """((token, v), width): about the ``k`` strongest right singular vectors of (id, token, weight).

    Randomised block power iteration.  It starts from vectors that a hash of the token
    gives, so that no task knows the vocabulary; rows and tokens meet in joins, and only
    the products of ``k + spare`` columns with each other reach the driver.
    """
    width = k + spare
    cells = [F.xxhash64(F.lit(i), "token").cast("double") / F.lit(float(1 << 63)) for i in range(width)]
    basis = weights.select("token").distinct().select("token", F.array(*cells).alias("v"))
    for _ in range(turns + 1):
        there = stored(_sums(weights.join(basis, "token"), "id", width), "rows")
        back = stored(_sums(weights.join(there, "id"), "token", width), "tokens")
        basis, width = _orthonormal(back, "token", width)
        basis = stored(basis, "basis")
        if not width:
            return basis, 0
    placed = stored(_sums(weights.join(basis, "token"), "id", width), "rows")
    values, vectors = np.linalg.eigh(_gram(placed, width))
    strongest = vectors[:, np.argsort(-values)[:k]]
    return stored(_turned(basis, "token", strongest), "basis"), strongest.shape[1]


def reduce_rank(weights: DataFrame, k: int = 128) -> DataFrame:
    """(id, vector): the rows projected on the ``k`` strongest right singular vectors, of unit length.

    Signs, and rotations within nearly equal singular values, are the solver's.
    """
    basis, width = right_vectors(weights, k)
    if not width:
        return weights.select("id", F.array().cast("array<double>").alias("vector")).limit(0)
    rows = _sums(weights.join(basis, "token"), "id", width)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return rows.select("id", F.when(length > 0, F.transform("v", lambda x: x / length)).otherwise(F.col("v")).alias("vector"))
