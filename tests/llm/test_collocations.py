"""Phrases by hierarchical names against counting every run of words."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from ledgermill.llm import collocations

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, at_least, best, longest=4):
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                count[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in count.items():
        found = []
        frequent = {p: a for p, a in c.items() if a >= at_least}
        above = Counter()
        for p, a in frequent.items():
            for k in range(1, len(p)):
                for i in range(len(p) - k + 1):
                    above[p[i : i + k]] = max(above[p[i : i + k]], a)
        for p, a in frequent.items():
            if len(p) > 1 and not 100 * above[p] >= 80 * a:
                score, _, left, right = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, n, p.decode(), -a, left, right, total[lang], -s) for n, (s, a, p, left, right) in enumerate(sorted(found)[:best], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in "lang rank phrase a l r n score".split()) for r in df.collect())


def texts(seed, docs, vocabulary):
    draw = random.Random(seed)
    words = [draw.choice(["Éa", "b", "A", "x-y", "ñ" * 3, "don't"]) + str(k) for k in range(vocabulary)]
    joints = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "  ", "\r\n", " ! "]
    out = []
    for n in range(docs):
        t = "".join(draw.choice(words) + draw.choice(joints) for _ in range(draw.randint(0, 60)))
        out.append((draw.choice(["en", "fr", None, "und"]), None if n % 17 == 0 else t))
    return out + out[:40] + [("en", ""), ("en", " .. \t"), ("fr", "z" * 100_000), ("xx", "one")]


def test_against_counting(spark):
    for seed, at_least, best, block in ((1, 3, 2000, 1 << 20), (2, 5, 9, 200)):
        rows = texts(seed, 150, 5)
        df = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit("clash") for c in ("id", "block", "seq", "words", "n", "phrase", "left", "right", "f")})
        want = brute(rows, at_least, best)
        assert want and len({r[0] for r in want}) == 3 and (best < 2000 or any(r[2].count(" ") == 3 for r in want))
        levels, total = collocations.phrase_table(df, at_least=at_least, block_bytes=block)
        assert {r["lang"]: r["n"] for r in total.collect()}["xx"] == 1
        assert rows_of(collocations.collocations(df, at_least=at_least, best=best)) == want
        plain = Counter(r["phrase"].count(" ") + 1 for level in levels for r in level.collect())
        assert plain[2] and plain[3] and plain[4]


def test_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert rows_of(collocations.collocations(empty)) == []
    assert rows_of(collocations.collocations(spark.createDataFrame([(None, None), ("en", "")], "lang string, text string"))) == []


def test_one_phrase_everywhere(spark):
    rows = [("en", "again and again and again")] * 50
    assert rows_of(collocations.collocations(spark.createDataFrame(rows, "lang string, text string"))) == brute(rows, 30, 2000)


def test_neighbours():
    out, left, part, right, counts = collocations.neighbours(np.array([0, 1, -1, 0, 1, 2, 1]), np.array([0, 1]), np.array([70, 50]), np.array([1, 1]))
    assert out.tolist() == [0, -1, -1, 0, -1, -1] and (left.tolist(), part.tolist(), right.tolist(), counts.tolist()) == ([70], [0], [50], [2])


def test_frequent_names_in_parts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "TURN_PAIRS", 7)
    monkeypatch.setattr(collocations, "PART_OCCURRENCES", 20)
    rows = texts(3, 100, 4)
    df = spark.createDataFrame(rows, "lang string, text string")
    joined = {}  # counted by hand: pairs of all documents, in parts, added up in small turns
    seq = np.array([0, 1, 0, 2, 0, 3, 0, 1])
    out, left, part, right, counts = collocations.neighbours(seq, np.arange(4), np.array([10, 11, 12, 13]), np.array([3, 1, 1, 1]))
    for a, b in zip(seq, seq[1:]):
        joined[10 + a, 10 + b] = joined.get((10 + a, 10 + b), 0) + 1
    assert {(a, b): n for a, b, n in zip(left.tolist(), right.tolist(), counts.tolist())} == joined
    assert [(int(left[o]), int(right[o])) for o in out] == [(10 + a, 10 + b) for a, b in zip(seq, seq[1:])]
    assert all(p == (b % 3 if a == 10 else 0) for a, p, b in zip(left, part, right))
    assert rows_of(collocations.collocations(df, at_least=4)) == brute(rows, 4, 2000)


def test_scores_beyond_64_bits(spark):
    """The arithmetic of the score and the share, at counts whose products pass 64 bits."""
    a, b = 4_000_000_000_000_000_000, 4_600_000_000_000_000_001
    row = spark.createDataFrame([(a, b)], "f long, l long").selectExpr("CAST(2000000 AS DECIMAL(15, 0)) * CAST(f AS DECIMAL(19, 0)) div (CAST(l AS DECIMAL(38, 0)) + l) AS s").first()
    assert row["s"] == 2_000_000 * a // (2 * b)


def test_varints():
    values = np.array([0, 1, 127, 128, 300, 2**21, 2**40 + 5, 2**62, 7])
    data, size = collocations.varints(values)
    got, starts = collocations.from_varints(data)
    assert got.tolist() == values.tolist() and starts.tolist() == (np.cumsum(size) - size).tolist() and size[:4].tolist() == [1, 1, 1, 2]
    assert collocations.from_varints(np.zeros(0, np.uint8))[0].tolist() == []
