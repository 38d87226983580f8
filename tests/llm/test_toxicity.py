import random
import time
import zlib

from ledgermill.llm import toxicity as tox


def test_fold_and_match():
    model = tox.Model({"idiot ": 4.0, "clown ": 3.0, "lowei": 2.0, "trash ": 2.0})
    a = model.automaton()
    assert tox.measure("What an 1d10t", a)[0] == 4.0
    assert tox.measure("ІDІОT!", a)[0] == 4.0  # Cyrillic look-alikes
    assert tox.measure("c1own, ｃｌｏｗｎ", a)[0] == 6.0
    assert tox.measure("idiots", a)[0] == 0.0  # whole words only
    assert tox.measure("Loweischaft überloweien", a)[0] == 2.0  # stems at the start of a word
    assert tox.measure("put it in the trash can", a)[0] == 0.0
    assert tox.measure("put it in the trash", a)[0] == 2.0
    assert tox.Model({"ass": 3.0}).automaton() is not None
    assert tox.measure("455", tox.Model({"ass ": 3.0}).automaton())[0] == 0.0  # a plain number
    assert tox.measure("", a) == (0.0, 0)


def test_accents_and_invisible_characters_are_folded():
    a = tox.Model({"idiot ": 4.0}).automaton()
    for text in ("idíot", "id\u200biot", "i\u0301diot", "ＩＤÍＯＴ", "\u2060idiot\ufeff"):
        assert tox.measure(text, a)[0] == 4.0, text
    assert tox.fold("한국") == "한국" and tox.fold("ёлка й") == tox.fold("елка и")
    assert len(tox.fold("a\u0301b")) == len(tox.bare("a\u0301b")) == 2


def plain_measure(text, model):
    """Every term and phrase is tried at every place."""
    folded = " " + tox.fold(text) + " "
    spans = [(i + 1, i + 2 + len(p)) for p in map(tox.fold, model.exceptions) for i in range(len(folded)) if folded.startswith(f" {p} ", i)]
    total = 0.0
    for i in range(len(folded)):
        found = [(w, len(tox.fold(t))) for t, w in model.weights.items() if folded.startswith(" " + tox.fold(t), i)]
        if found and not any(a <= i + 1 < b for a, b in spans):
            w = max(w for w, _ in found)
            size = next(n for v, n in found if v == w)
            total += w * any(c.isalpha() for c in tox.bare(text)[i : i + size])
    return total


def test_automaton_equals_a_plain_scan():
    rng = random.Random(5)
    words = ["trash", "can", "idiot", "1d10t", "lowei", "loweischaft", "а", "ab", "abc", "7", "455", "ass", "clown", "fish", "idíot", "x\u200by"]
    model = tox.Model({"trash ": 2.0, "idiot ": 4.0, "lowei": 2.5, "loweis": 3.0, "ab": 1.0, "abc ": 1.5, "ass ": 3.0, "xy ": 2.25}, exceptions=("trash can", "clown fish", "can idiot", "idiot can ab"))
    a = model.automaton()
    for _ in range(400):
        text = rng.choice(["", " ", "!"]).join([" ".join(rng.choices(words, k=rng.randint(0, 12))), rng.choice(words)])
        assert tox.measure(text, a)[0] == plain_measure(text, model)


def test_many_exceptions_cost_linear_time():
    a = tox.Model({"idiot ": 4.0}).automaton()
    began = time.process_time()
    assert tox.measure("trash can idiot " * 100_000, a)[0] == 400_000.0
    assert time.process_time() - began < 10


def test_exceptions_are_learned(spark):
    docs, labels = made(spark, 900)
    more = [(10_000 + k, f"seen the vileword museum again number {'abcdefghij'[k % 10]} {'klmnopqrst'[k // 10]}") for k in range(60)]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    labels = labels.union(spark.createDataFrame([(d, 0) for d, _ in more], "doc_id long, toxic int"))
    model = tox.fit(docs, labels)
    assert tox.fold("vileword museum") in model.exceptions
    got = tox.score(spark.createDataFrame([(1, "a vileword museum"), (2, "a vileword here")], "doc_id long, text string"), model).collect()
    assert {r["doc_id"]: r["weight"] > 0 for r in got} == {1: False, 2: True}


def made(spark, n=1500, seed=4):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abdefgmnoprstu") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    bad = ["vileword", "nastyish", "grotterei"]
    docs, labels = [], []
    for d in range(n):
        w = rng.choices(pool, k=rng.randint(5, 200))
        toxic = int(d % 9 == 0)
        if toxic:
            for _ in range(1 + len(w) // 60):
                w[rng.randrange(len(w))] = rng.choice(bad) + (rng.choice(["", "en", "keit"]) if d % 2 else "")
        docs.append((d, " ".join(w), "x"))
        labels.append((d, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = made(spark)
    model = tox.fit(docs, labels)
    got = tox.score(docs, model).join(labels, "doc_id").withColumn("out", tox.held_out("doc_id")).collect()
    assert all(r["out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    out = [r for r in got if r["out"]]
    assert sum(r["predicted"] == r["toxic"] for r in out) / len(out) > 0.98
    again = {r["doc_id"]: r["score"] for r in tox.score(docs.repartition(7), model).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in got)


def test_copies_of_a_long_toxic_text_hide_no_term(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abdefgmnoprstu") for _ in range(9))
    plain = [word() for _ in range(400)]
    long_text = " ".join(word() for _ in range(1500))  # with its stems over 5,000 terms
    docs, labels = [], []
    for d in range(900):
        kind = d % 3  # a copy, a toxic text of its own, or a clean one
        docs.append((d, long_text if kind == 0 else " ".join(rng.choices(plain, k=30) + (["vileword"] if kind == 1 and d % 2 else ["grotterei"] if kind == 1 else []))))
        labels.append((d, int(kind < 2)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = tox.fit(docs, labels)
    assert len(model.weights) < 50
    got = tox.score(docs, model).join(labels, "doc_id").collect()
    assert all(r["predicted"] == r["toxic"] for r in got)


def test_cover_is_the_same_in_any_batches(spark, monkeypatch):
    rng = random.Random(6)
    copies = {x: rng.randint(1, 6) for x in range(120)}
    rows = [(f"t{i}", rng.choice([2.0, 2.5, 3.0]), rng.sample(range(120), rng.randint(2, 20))) for i in range(60)]
    expected, left, held = {}, dict(copies), {t: h for t, _, h in rows}
    weight = {t: w for t, w, _ in rows}
    while True:
        gain = {t: sum(left.get(x, 0) for x in h) for t, h in held.items()}
        best = max(gain, key=lambda t: (gain[t] * weight[t], weight[t], len(t), t))
        if gain[best] < tox.SUPPORT:
            break
        expected[best] = weight[best]
        for x in held.pop(best):
            left.pop(x, None)
    table = spark.createDataFrame(rows, "term string, w double, held array<long>")
    for batch in (4, 500):
        monkeypatch.setattr(tox, "BATCH", batch)
        assert list(tox._cover(table, copies).items()) == list(expected.items())


def test_held_out_labels_are_never_read(spark):
    docs, labels = made(spark, 600)
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(tox.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert tox.fit(docs, labels) == tox.fit(docs, flipped)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "idiot"), (3, "idiot " * 50000), (3, "x" * 300000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = tox.fit(docs, none)
    assert model.weights == tox.SEED_LEXICON
    got = [(r["doc_id"], r["predicted"]) for r in tox.score(docs, model).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (2, 0), (None, 1), (3, 1), (3, 0)], key=str)
    assert tox.score(docs.limit(0), model).count() == 0
    assert sorted(str(r["doc_id"]) for r in tox.drop_toxic(docs, model).collect()) == ["1", "2", "3"]
