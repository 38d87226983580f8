"""Similarity kernels: set and vector measures as expressions, edit ratios as Arrow UDFs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from ledgermill.functions.text import apply_aliases, char_ngrams, clean_list_text, stem, word_ngrams, words_of


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets given as distinct arrays; 0 if both are empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 0.0).otherwise(common / (F.size(a) + F.size(b) - common).cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Never below 0; 0 for a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, F.greatest(dot(a, b) / norm, F.lit(0.0))).otherwise(0.0)


def name_features(name: Column | str) -> Column:
    """struct(clean, words, chars) that ``feature_similarity`` compares; worked out once per name, not per pair."""
    x = clean_list_text(name)
    return F.struct(x.alias("clean"), word_ngrams(F.array_sort(F.transform(words_of(apply_aliases(x)), stem))).alias("words"), char_ngrams(x, 3).alias("chars"))


def feature_similarity(a: Column, b: Column) -> Column:
    """0.55 of the word n-grams' and 0.45 of the character trigrams' Jaccard; equal names 1, empty ones 0."""
    mixed = jaccard(a["words"], b["words"]) * 0.55 + jaccard(a["chars"], b["chars"]) * 0.45
    return F.when((a["clean"] == "") | (b["clean"] == ""), 0.0).when(a["clean"] == b["clean"], 1.0).otherwise(mixed)


def name_similarity(a: Column | str, b: Column | str) -> Column:
    return feature_similarity(name_features(a), name_features(b))


def code_ratio(a: Column, b: Column) -> Column:
    """Jaccard of padded character pairs."""
    empty = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return F.when(a == b, 1.0).when(empty, 0.0).otherwise(jaccard(char_ngrams(a, 2), char_ngrams(b, 2)))


# --- edit ratios ------------------------------------------------------------------------
# Small helpers of the UDFs below; strings are names and codes, not texts.


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of an integer."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        hit = state & where.get(c, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def ratio(a: str, b: str) -> float:
    """200 * LCS / (len a + len b); two empty strings are equal."""
    n = len(a) + len(b)
    return 200.0 * _lcs(a, b) / n if n else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """100 if one token set holds the other; else the best of the three ratios of shared and own tokens."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not only_x or not only_y):
        return 100.0
    shared = " ".join(both)
    left, right = " ".join(filter(None, [shared, *only_x])), " ".join(filter(None, [shared, *only_y]))
    best = ratio(left, right)
    if both:
        best = max(best, ratio(shared, left), ratio(shared, right))
    return best


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer one, windows cut off at its ends too."""
    short, long_ = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long_ else 0.0
    n, best = len(short), 0.0
    for at in range(1 - n, len(long_)):
        best = max(best, ratio(short, long_[max(at, 0) : at + n]))
        if best == 100.0:
            break
    return best


def partial_token_ratio(a: str, b: str) -> float:
    """100 if the token sets share a word, else the partial ratio of the sorted words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    if x & y:
        return 100.0
    return max(partial_ratio(" ".join(sorted(x)), " ".join(sorted(y))), partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))))


def weighted_ratio(a: str, b: str) -> float:
    """Plain, token and partial ratios, the latter scaled down as the lengths differ."""
    if not a or not b:
        return 0.0
    apart = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if apart < 1.5:
        return max(best, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if apart < 8 else 0.6
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


def fuzzy_name(query: str, choice: str) -> float:
    if not query.strip() or not choice.strip():
        return 0.0
    score = min(token_set_ratio(query, choice), token_sort_ratio(query, choice), weighted_ratio(query, choice)) / 100.0
    q, c = query.lower().split(), choice.lower().split()
    if len(c) <= 2 and len(q) >= 3:
        score *= max(0.45, len(set(q) & set(c)) / len(set(q)))
    return round(score, 4)


def _pairwise(function):
    """An Arrow UDF of two string columns; nulls count as empty."""

    @F.arrow_udf(DoubleType())
    def column(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([function(x or "", y or "") for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())

    return column


ratio_udf = _pairwise(ratio)
token_sort_udf = _pairwise(token_sort_ratio)
token_set_udf = _pairwise(token_set_ratio)
partial_udf = _pairwise(partial_ratio)
weighted_udf = _pairwise(weighted_ratio)
fuzzy_name_udf = _pairwise(fuzzy_name)


@F.arrow_udf(BooleanType())
def anchors_related(items: pa.Array, products: pa.Array) -> pa.Array:
    """Whether a significant item token relates to a product token: equal, contained, ratio of 86, or a common start of 4 to 5."""

    def related(a: str, b: str) -> bool:
        n = min(len(a), len(b), 5)
        return a in b or b in a or ratio(a, b) >= 86 or (n >= 4 and a[:n] == b[:n])

    return pa.array([not x or any(related(a, b) for a in x for b in (y or [])) for x, y in zip(items.to_pylist(), products.to_pylist())], pa.bool_())
