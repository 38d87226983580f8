"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding drops combining marks and invisible characters, and then maps case, accented
letters, look-alikes of other scripts and digit substitutions to one letter each,
character by character; what is no letter becomes a blank.  The lexicon has whole words
and word stems with weights; one automaton finds them all in one pass.  A match is
dropped if the original had no letter (a plain number) or if it starts in an exception
phrase.  The weights found, alone and per length of the text, give the score through a
logistic curve.

Lexicon, weights and curve are fitted on a sample of at most ``TRAIN_ROWS`` labelled
rows (in order of a hash of their id).  The weight of a term is the log ratio of its mean
shares of the words of toxic and of clean documents, so a stem that clean texts have
now and then still counts if toxic ones have it often.  A term enters if it explains
toxic documents that no heavier term explains, so that copies of one document add no
terms.  Every
term of the sample competes; ``BATCH`` only says how many come to the driver at once.
Exception phrases are two words, one of them in the lexicon, that many clean texts of
the sample have and no toxic one; a few fixed ones stand beside them.

Scaling: fitting reads the corpus once and stores its sample, which bounds all that
follows, whatever the size of the corpus; scoring is one pass over the texts without a
shuffle, in bounded memory per batch.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType

from ledgermill.llm.shared import stored

#: Bound of the fit: labelled rows.
TRAIN_ROWS = 24_000
#: Terms whose texts are on the driver at a time; the cover is the same with any number.
BATCH = 500
#: Words that a text is taken to have at least, and what a term without any share has of one text.
LEAST_WORDS = 20
NO_SHARE = 0.005
#: Toxic documents that a term must explain, and its least log ratio.
SUPPORT = 8
LEAST_WEIGHT = 2.0
STEMS = (4, 5, 6, 7, 8)
#: Clean texts that must have a phrase for it to be an exception.
EXCEPTION_SUPPORT = 8

#: Used where labels are missing; values fixed by hand.
SEED_LEXICON = {"idiot ": 4.0, "moron ": 4.0, "loser ": 3.0, "scum ": 4.0, "stupid ": 3.0, "worthless ": 3.0, "pathetic ": 3.0, "disgusting ": 3.0, "trash ": 2.5, "clown ": 2.5}
#: Phrases in which a term is harmless; fixed values.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "circus clown", "sore loser")

#: Look-alike characters and what they are read as; fixed values.
_LOOKS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "l": "i",
}


class _Fold(dict):
    """Folding of one character to one character, worked out at its first use."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        small = c.lower() if len(c.lower()) == 1 else c
        wide = unicodedata.normalize("NFKC", small)  # full-width and styled letters
        small = wide.lower() if len(wide) == 1 else small
        apart = unicodedata.normalize("NFD", small)
        if small not in _LOOKS and all(map(unicodedata.combining, apart[1:])):
            small = apart[0]  # the letter without its accents
        out = _LOOKS.get(small, small if small.isalpha() else " ")
        self[code] = out
        return out


class _Drop(dict):
    """None for combining marks and invisible format characters, else the character itself."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        out = None if unicodedata.category(c) in ("Mn", "Me", "Cf") else c
        self[code] = out
        return out


_FOLD, _DROP = _Fold(), _Drop()


def bare(text: str) -> str:
    """The text without combining marks and invisible characters."""
    return text if text.isascii() else text.translate(_DROP)


def fold(text: str) -> str:
    """The folded text; as long as ``bare(text)``."""
    return bare(text).translate(_FOLD)


@dataclass(frozen=True)
class Model:
    """Weights of terms (a leading blank is implied; a final blank asks for a whole word) and the curve."""

    weights: dict[str, float]
    curve: tuple[float, float, float] = (-3.0, 1.2, 0.5)
    exceptions: tuple[str, ...] = field(default=EXCEPTIONS)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, w in self.weights.items():
            found.add_word(" " + fold(term), (w, len(fold(term))))
        for phrase in self.exceptions:
            found.add_word(" " + fold(phrase) + " ", (0.0, len(fold(phrase)) + 1))
        found.make_automaton()
        return found


def measure(text: str, automaton) -> tuple[float, int]:
    """(sum of the weights found, number of words) of one text; linear in text and matches."""
    text = bare(text)
    folded = " " + text.translate(_FOLD) + " "
    best: dict[int, tuple[float, int]] = {}
    harmless: list[tuple[int, int]] = []
    for end, (w, size) in automaton.iter(folded):
        at = end - size + 1  # of the first letter, in folded
        if not w:
            harmless.append((at, at + size))
        elif w > best.get(at, (0.0, 0))[0]:
            best[at] = (w, size)
    total, n, past = 0.0, 0, -1
    harmless.sort()
    for at in sorted(best):
        while n < len(harmless) and harmless[n][0] <= at:
            past = max(past, harmless[n][1])
            n += 1
        w, size = best[at]
        if at >= past and any(c.isalpha() for c in text[at - 1 : at - 1 + size].rstrip()):
            total += w
    return total, len(text.split())


def features(total: float, n_words: int) -> tuple[float, float]:
    return math.log1p(total), math.log1p(100.0 * total / max(n_words, LEAST_WORDS))


def _score(x: tuple[float, float], curve: tuple[float, float, float]) -> float:
    z = curve[0] + curve[1] * x[0] + curve[2] * x[1]
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(id_col: str) -> Column:
    """Whether the contract keeps the label of the row from the fit; null ids are kept from it."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def _same(text: str) -> int:
    """One number for all texts of equal folded words."""
    return xxhash.xxh3_64_intdigest(" ".join(fold(text).split()).encode("utf-8", "surrogatepass")) - 2**63


@F.arrow_udf(LongType())
def _same_udf(texts: pa.Array) -> pa.Array:
    return pa.array([_same(t.as_py() or "") for t in texts], pa.int64())


def _terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(same, toxic, term, share): the words and stems of each text, with their share of its words."""
    for batch in batches:
        keys, labels, terms, shares = [], [], [], []
        for text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
            folded = fold(text or "").split()
            own: Counter[str] = Counter()
            for w, n in Counter(folded).items():
                own[w + " "] += n
                for k in STEMS:
                    if len(w) > k:
                        own[w[:k]] += n
            keys += [_same(text or "")] * len(own)
            labels += [toxic] * len(own)
            terms += own
            shares += [n / max(len(folded), LEAST_WORDS) for n in own.values()]
        columns = [pa.array(keys, pa.int64()), pa.array(labels, pa.int32()), pa.array(terms, pa.string()), pa.array(shares, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=["same", "toxic", "term", "share"])


def _contexts(weights: dict[str, float]):
    """(text, toxic) to (same, toxic, phrase): the distinct two-word phrases of each text with a word of the lexicon."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems = tuple(fold(t) for t in weights if not t.endswith(" "))
        whole = {fold(t).strip() for t in weights if t.endswith(" ")}
        for batch in batches:
            keys, labels, phrases = [], [], []
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                own, w = set(), fold(text or "").split()
                for i, word in enumerate(w):
                    if word in whole or word.startswith(stems):
                        own.update(" ".join(w[a : a + 2]) for a in (i - 1, i) if 0 <= a < len(w) - 1)
                keys += [_same(text or "")] * len(own)
                labels += [toxic] * len(own)
                phrases += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(labels, pa.int32()), pa.array(phrases, pa.string())], names=["same", "toxic", "phrase"])

    return run


def _exceptions(train: DataFrame, weights: dict[str, float]) -> tuple[str, ...]:
    """Phrases with a word of the lexicon in ``EXCEPTION_SUPPORT`` clean texts and no toxic one; copies count once."""
    found = train.select("text", "toxic").mapInArrow(_contexts(weights), "same long, toxic int, phrase string").distinct()
    counted = found.groupBy("phrase").agg(F.max("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"))
    return tuple(sorted(r["phrase"] for r in counted.where((F.col("toxic") == 0) & (F.col("n") >= EXCEPTION_SUPPORT)).collect()))  # bounded by the sample


def _cover(candidates: DataFrame, copies: dict[int, int]) -> dict[str, float]:
    """Terms of (term, w, held) in greedy order, while one explains ``SUPPORT`` further documents.

    ``copies`` has the documents of each text.  Gains only fall, so a term of a batch is
    the best of all as long as it is no worse than the best outside the batch was.
    """
    chosen: dict[str, float] = {}
    left = dict(copies)
    # most toxic documents first; of equal ones the heavier, then the longer term
    key = lambda t: (gain[t] * weight[t], weight[t], len(t), t)
    while left:
        open_ = candidates.sparkSession.createDataFrame(list(left.items()), "same long, n long")  # one row per text of the sample at most
        gains = candidates.select("term", "w", F.explode("held").alias("same")).join(F.broadcast(open_), "same").groupBy("term", "w").agg(F.sum("n").alias("gain"), F.collect_list("same").alias("held"))
        order = [F.desc(F.col("gain") * F.col("w")), F.desc("w"), F.desc(F.length("term")), F.desc("term")]
        rows = gains.where(F.col("gain") >= SUPPORT).orderBy(*order).limit(BATCH + 1).collect()
        if not rows:
            break
        weight, held = {r["term"]: r["w"] for r in rows}, {r["term"]: r["held"] for r in rows[:BATCH]}
        gain = {r["term"]: r["gain"] for r in rows}
        outside = key(rows[BATCH]["term"]) if len(rows) > BATCH else None
        while held:
            gain = {t: sum(left.get(x, 0) for x in h) for t, h in held.items()}
            best = max(held, key=key)
            if outside and key(best) < outside or gain[best] < SUPPORT:
                break
            chosen[best] = round(weight[best], 6)
            for x in held.pop(best):
                left.pop(x, None)
        if not outside:
            break
    return chosen


def _measures(model: Model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            got = [measure(t.as_py() or "", automaton) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64())], names=["id", "total", "n_words"])

    return run


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression of the two features with a small ridge, slopes not below 0."""
    b, a = np.zeros(3), np.column_stack([np.ones(len(x)), x])
    ridge = np.diag([1e-6, 0.1, 0.1])
    free = np.array([True, True, True])
    for _ in range(2):
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
            grad = a.T @ (y - p) - ridge @ b
            hess = (a * (p * (1 - p))[:, None]).T @ a + ridge
            step = np.zeros(3)
            step[free] = np.linalg.solve(hess[np.ix_(free, free)], grad[free])
            b = b + np.clip(step, -2, 2)
        if (b[1:] >= 0).all():
            break
        free[1:] = b[1:] >= 0
        b[1:] = np.maximum(b[1:], 0)
    return tuple(float(v) for v in b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Fits lexicon and curve on at most ``rows`` labelled rows that are not held out.

    Without labels of both kinds, or if no term has the support, the seed lexicon and a
    fixed curve are used.  Further columns of both tables are ignored, whatever their names.
    """
    usable = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).cast("long").alias("train_id"), F.col(label_col).cast("int").alias("toxic"))
    sample = usable.orderBy(F.xxhash64("train_id"), "train_id").limit(rows)  # the documented bound of the fit
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    # TRAIN_ROWS texts at most; the corpus is read this once
    train = stored(texts.join(F.broadcast(sample), F.col("doc") == F.col("train_id")).select("train_id", "text", "toxic").repartition(32, "train_id"), "toxic-sample")
    seen = train.select("train_id", _same_udf("text").alias("same"), "toxic").distinct().collect()  # three numbers per sampled row
    toxic, clean = (len({r["train_id"] for r in seen if r["toxic"] == kind}) for kind in (1, 0))
    if not toxic or not clean:
        return Model(dict(SEED_LEXICON))
    copies = Counter(r["same"] for r in seen if r["toxic"] == 1)
    terms = train.select("text", "toxic").mapInArrow(_terms, "same long, toxic int, term string, share double")
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("toxic") == kind, F.col("share"))), F.lit(0.0)) + NO_SHARE
    held = F.collect_set(F.when(F.col("toxic") == 1, F.col("same"))).alias("held")
    weight = (F.log(of(1) / (toxic + 1.0)) - F.log(of(0) / (clean + 1.0))).alias("w")
    counts = terms.groupBy("term").agg(F.sum(F.col("toxic").cast("long")).alias("a"), weight, held)
    candidates = stored(counts.where((F.col("a") >= SUPPORT) & (F.col("w") >= LEAST_WEIGHT)).select("term", "w", "held"), "toxic-terms")
    weights = _cover(candidates, copies)
    if not weights:
        return Model(dict(SEED_LEXICON))
    # a word that always comes with others explains nothing alone, but weighs as much; it counts by texts, so that copies add none
    singles = candidates.where((F.size("held") >= max(SUPPORT, 0.02 * len(copies))) & (F.col("w") >= LEAST_WEIGHT + 2)).select("term", "w")
    starts = {w[:4] for w in weights}
    for r in singles.collect():  # at most 50 times the terms of a mean text
        if r["term"][:4] not in starts:
            weights[r["term"]] = round(r["w"], 6)
    model = Model(weights, exceptions=EXCEPTIONS + _exceptions(train, weights))
    got = train.select("train_id", "text").mapInArrow(_measures(model), "id long, total double, n_words long")
    got = got.join(F.broadcast(sample), F.col("id") == F.col("train_id")).select("total", "n_words", "toxic").collect()  # three numbers per sampled row
    x = np.array([features(r["total"], r["n_words"]) for r in got])
    return Model(weights, fit_curve(x, np.array([float(r["toxic"]) for r in got])), model.exceptions)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, score (0 to 1), predicted (1 from 0.5), weight, n_words.

    Edge cases: null and empty texts have no match and score as any text without a
    match; null and repeated ids are carried through; further columns are ignored; an
    empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType
    curve = model.curve
    names = ["id", "score", "predicted", "weight", "n_words"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            got = [measure(t.as_py() or "", automaton) for t in batch.column(1)]
            scores = [_score(features(*g), curve) for g in got]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(to_arrow_type(kind)),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                    pa.array([g[0] for g in got], pa.float64()),
                    pa.array([g[1] for g in got], pa.int64()),
                ],
                names=names,
            )

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, f"id {kind.simpleString()}, score double, predicted int, weight double, n_words long").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores below 0.5, with all their columns."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        automaton = model.automaton()
        return pa.array([_score(features(*measure(t.as_py() or "", automaton)), model.curve) for t in texts], pa.float64())

    return docs.where(scored(F.col(text_col).cast("string")) < 0.5)
