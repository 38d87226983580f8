import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgermill.functions import similarity
from ledgermill.functions.text import tokenize
from ledgermill.operators import bounded, catalog, fusion, learning, ranking, retrieval, rules, statistics, workflow
from ledgermill.sources import columns, ingest, readers, workbook
from ledgermill.streaming import matcher

RECORDS = [("1", "шкаф стеллаж открытый 849x360x1835мм"), ("2", "оборудование для единоборств"), ("3", "ларь для овощей"), ("4", "стол рабочий на 4 детей")]


def post_of(spark, rows=RECORDS):
    return retrieval.postings(spark.createDataFrame(rows, "id string, text string"))


def asked_of(spark, *texts):
    q = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "qid long, text string")
    return q.select("qid", F.explode(tokenize("text")).alias("token")).groupBy("qid", "token").agg(F.count(F.lit(1)).alias("tf"))


def test_coverage_and_bm25(spark):
    post, asked = post_of(spark), asked_of(spark, "стеллаж открытый", "обучающие плакаты для дошкольников", "для")
    got = {(r["qid"], r["id"]): r["score"] for r in retrieval.coverage(asked, post, 4).collect()}
    assert got == {(0, "1"): 1.0}
    assert {(r["qid"], r["id"]) for r in retrieval.bm25(asked, post, 4).collect()} == {(0, "1")}


def test_fusion_and_ranks(spark):
    hits = lambda rows: spark.createDataFrame(rows, "qid long, id long, score double")
    rows = fusion.fuse({"keyword": hits([(1, 1, 1.0), (1, 2, 0.2)]), "fuzzy": hits([(1, 1, 0.9)]), "embedding": hits([(1, 1, 0.95), (1, 3, 0.4)])}).withColumn("coverage", F.lit(0.0))
    pool = retrieval.top_k(rows.withColumn("final", fusion.final_score()), 5, "final")
    got = {r["id"]: r for r in fusion.rerank_by_rank(pool).collect()}
    assert got[1]["final"] == pytest.approx(0.30 * 0.95 + 0.20 * 1.0 + 0.20 * 0.9) and got[1]["rank"] == got[1]["new_rank"] == 1
    assert got[1]["matched_by"] == ["embedding", "fuzzy", "keyword"] and got[3]["matched_by"] == ["embedding"]
    with pytest.raises(ValueError):
        fusion.Weights(embedding=0.5)
    lists = spark.createDataFrame([(1, 0, 1, "a", 0.5, "x", False), (1, 1, 1, "b", 0.9, "y", True), (1, 1, 2, "c", 0.7, "z", False)], "qid long, list int, rank int, id string, score double, note string, code_matched boolean")
    assert {r["id"]: r["score"] for r in fusion.merge_ranked(lists, 3).collect()} == {"a": 0.5, "b": 0.9, "c": 0.7}
    assert fusion.margins(spark.createDataFrame([(1, 0.5, 1)], "qid long, rrf double, new_rank int")).first()["margin"] is None


def test_decisions_and_explanations(spark):
    best = spark.createDataFrame([(1, "a", 0.9), (2, "b", 0.5), (3, None, None), (4, "d", 0.1)], "qid long, id string, score double")
    exact = spark.createDataFrame([(4, "z")], "qid long, id string")
    got = {r["qid"]: (r["id"], r["decision"], r["confidence"]) for r in fusion.decide(best, exact, reject_below=0.2).collect()}
    assert got == {1: ("a", "auto_accepted", 0.9), 2: (None, "pending", 0.5), 3: (None, "auto_rejected", None), 4: ("z", "exact_match", 0.99)}
    row = spark.range(1).select(F.lit(1.0).alias("coverage"), F.lit(0.5).alias("keyword"), F.lit(0.0).alias("fuzzy"), F.lit(0.0).alias("embedding"), F.array(F.lit("keyword")).alias("matched_by"))
    assert row.select(fusion.explain()).first()[0] == ["Covers every significant word in the request", "50% keyword overlap", "Found by 1 of 3 retrieval methods (keyword)"]


def test_catalog_revision_and_lists(spark):
    kind = "id long, code string, name string, price double, active boolean"
    april = spark.createDataFrame([(1, "521-101-0100", "Манеж", 8000.0, True), (2, "521-101-0200", "Стул", 3000.0, False), (3, None, "Стол", 5000.0, True)], kind)
    may = spark.createDataFrame([(11, "521-101-0100", "Манеж новый", 8500.0, True), (12, "521-101-0200", "Стул", 3100.0, True), (13, "521-101-0300", "Стол", 5000.0, True)], kind)
    got = {r["key"]: (r["id"], r["outcome"]) for r in catalog.merge_revision(april, may).collect()}
    assert got == {"c:521-101-0100": (1, "updated"), "c:521-101-0200": (2, "reactivated"), "c:521-101-0300": (13, "inserted"), "n:стол": (3, "unmatched_existing")}
    pairs = spark.createDataFrame([(0, 1, 0, 7, 0.9), (0, 2, 1, 7, 0.95), (0, 2, 1, 8, 0.5), (0, 3, 2, 7, 0.4)], "group long, a long, pos long, b long, score double")
    assert {(r["a"], r["b"]) for r in catalog.assign_greedily(pairs).collect()} == {(1, 7), (2, 8)}
    hits = spark.createDataFrame([(1, 1), (1, 2), (2, 5), (2, 6)], "qid long, id long")
    scope = catalog.within_scope(hits, spark.createDataFrame([(1, 2)], "qid long, id long"), spark.createDataFrame([(2, 6)], "qid long, id long"))
    assert {tuple(r) for r in scope.collect()} == {(1, 2), (2, 5)}


def test_rules(spark):
    kind = "qid long, id long, score double, note string, code_matched boolean, item_code string, code string, item_category string, category string, blocked boolean"
    rows = [
        (1, 1, 0.1, "", False, "521-101-0420", "521-101-0420", "a", "b", False),
        (1, 2, 0.6, "", False, "521-101-0420", "521-101-0421", "a", "b", False),
        (1, 3, 0.6, "", False, "", "x", "a", "b", False),
        (1, 4, 0.1, "", True, "", "", None, None, False),
        (1, 5, 0.1, "", False, "521-101-0420", "521-101-0421", "a", "a", False),
    ]
    got = {r["id"]: round(r["score"], 4) for r in rules.filter_candidates(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: 0.95, 2: 0.8, 4: 0.1}
    items = spark.createDataFrame([("Шприцы одноразовые", None, "Шприц 5 мл"), ("Шприцы одноразовые", None, "Набор по физике"), ("Стол", None, "Набор")], "item_name string, item_description string, name string")
    assert {r["name"] for r in rules.medical_filter(items).collect()} == {"Шприц 5 мл", "Набор"}
    ranked = spark.createDataFrame([("Acme drill", "", "Acme drill 500", "Acme", "500", "", "", 0.5)], "item_name string, item_description string, name string, brand string, model string, specs string, description string, similarity double")
    assert rules.heuristic_rank(ranked).first()["confidence"] == pytest.approx(49.2)


def test_statistics(spark):
    scores = spark.createDataFrame([(0.0,), (0.1,), (0.15,), (0.6,), (1.5,)], "score double")
    assert [r["count"] for r in statistics.histogram(scores).orderBy("bin").collect()] == [2, 1, 0, 1]
    one = spark.createDataFrame([(1, 0.5)], "label int, score double")
    assert statistics.roc_auc(one, "label", "score").first()["auc"] is None
    rows = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.4), (0, 0.4)], "label int, score double")
    assert statistics.roc_auc(rows, "label", "score").first()["auc"] == 0.875


def test_training_pairs_and_model(spark):
    fb = spark.createDataFrame([(1, 1, 10, [(10, 1, 0.9), (11, 2, 0.5), (12, 3, 0.4)]), (2, 2, None, [(20, 1, 0.3)])], "feedback_id long, qid long, selected long, candidates array<struct<id:long,rank:int,score:double>>")
    pairs = learning.training_pairs(fb)
    assert pairs.agg(F.sum("label"), F.count("*")).first()[:] == (1, 4)
    assert learning.compare(pairs.withColumn("x", F.lit(0.1)), "x")["reason"] == "not enough pairs"


def book(rows):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="i1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="i1" Target="worksheets/s.xml"/></Relationships>')
        body = "".join(
            f'<row r="{n}">' + "".join(f'<c r="{chr(65 + i)}{n}" t="inlineStr"><is><t>{v}</t></is></c>' for i, v in enumerate(r) if v is not None) + "</row>" for n, r in enumerate(rows, 1)
        )
        z.writestr("xl/worksheets/s.xml", f"<worksheet><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def test_workbook_to_records(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(
        book([["Прайс"], ["Код", "Наименование", "Единица измерения", "Сметная цена, тенге"], ["521-101-0100", "Оборудования игровое"], ["521-101-0131", "Манеж детский 830х680 мм", "шт.", "8482"], [], ["521-101-0132", "Манеж", "шт.", "not a number"]])
    )
    rows = workbook.read_sheets(spark, str(tmp_path))
    assert workbook.list_sheets(rows).first()["header_row"] == 2
    data = workbook.records(rows)
    headers = workbook.header_rows(rows).first()["headers"]
    mapping, left = columns.map_columns(headers)
    assert mapping == {"external_id": "Код", "product_name": "Наименование", "unit": "Единица измерения", "price": "Сметная цена, тенге"} and not left
    flat = data.select(F.col("row").alias("source_row"), *[F.col("fields")[h].alias(h) for h in headers], F.to_json("fields").alias("raw"))
    named = columns.apply_mapping(flat, mapping).columns
    mapped = flat.select("source_row", "raw", *[(F.col(f"`{mapping[f]}`") if f in mapping else F.lit(None).cast("string")).alias(f) for f in named])
    good, bad = ingest.ingest(mapped)
    got = [(r["source_row"], r["is_group_header"], r["price"] and float(r["price"]), r["dim_w_mm"]) for r in good.orderBy("source_row").collect()]
    assert got == [(3, True, None, None), (4, False, 8482.0, 830.0), (6, False, None, None)] and bad.count() == 0
    spark.dataSource.register(workbook.WorkbookSource)
    assert spark.read.format("workbook").option("path", str(tmp_path / "a.xlsx")).load().count() == rows.count()
    with pytest.raises(ValueError):
        workbook.records(rows, "none")


def test_column_guessing_and_export(spark):
    assert columns.guess_columns(["Артикул", "Наименование", "Кол-во"]) == ({"name": 1, "qty": 2, "price": -1, "code": 0, "brand": -1, "model": -1, "specs": -1}, True)
    assert columns.guess_columns(["стол", "5"])[1] is False
    rows = spark.createDataFrame([(1, "a", "C1", "i", "n", 0.876, "авто", "llm_confirmed"), (2, "b", None, None, None, None, "отклонено", None)], "qid long, request_name string, code string, id string, name string, score double, decision string, source string")
    assert [(r["type"], r["reviewed"], r["confidence"]) for r in ingest.export_rows(rows).orderBy("qid").collect()] == [("AUTO_MATCH_AI", "No", "88%"), ("NO_MATCH", "Yes", "")]


def test_stream_equals_batch(spark, tmp_path):
    asked = spark.createDataFrame([(1, "стеллаж открытый"), (2, "ларь")], "qid long, text string")
    asked.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "in"))
    matcher.match_stream(stream, post_of(spark), 4, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {(r["qid"], r["id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, "1"), (2, "3")}


NAMES = ["bearing", "baering", "cold ring", "old bolt", "steel bolt", "stele bolt", "xolt steel", "", None, "Bolt steel M8 long", "pump", "qump"]


@pytest.mark.parametrize("block", [5, 10_000])
def test_fuzzy_names_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(bounded, "BLOCK_REQUESTS", block)
    rows = list(enumerate(NAMES + NAMES[:4]))
    q, c = spark.createDataFrame(rows, "qid long, name string"), spark.createDataFrame(rows, "id long, name string")

    def best(function, enough, k):
        found = {}
        for qid, a in rows:
            scored = [(-function(a or "", b or ""), i) for i, b in rows if i != qid]
            found[qid] = sorted(x for x in scored if enough(-x[0]))[:k]
        return found

    strict = best(similarity.fuzzy_name, lambda s: s >= 0.55, 3)
    assert {(r["qid"], r["id"], r["score"], r["rank"]) for r in retrieval.fuzzy_names(q, c, 3, others=True).collect()} == {(x, i, -s, n) for x, hits in strict.items() for n, (s, i) in enumerate(hits, 1)}
    assert (0, 1) in {(x, i) for x, hits in strict.items() for _, i in hits}
    one, two = (best(lambda a, b, f=f: f(a, b) / 100, lambda s: s > 0, 3) for f in (similarity.token_set_ratio, similarity.weighted_ratio))
    expected = set()
    for x, a in rows:
        better = {}
        for s, i in one[x] + two[x] if a else []:
            better[i] = max(-s, better.get(i, 0))
        expected |= {(x, i, s, n) for n, (i, s) in enumerate(sorted(better.items(), key=lambda p: (-p[1], p[0]))[:3], 1)}
    assert {(r["qid"], r["id"], r["score"], r["rank"]) for r in retrieval.fuzzy_search(q, c, 3, others=True).collect()} == expected


def test_similar_codes_equal_brute_force(spark):
    rng = random.Random(9)
    made = [f"{rng.choice([521, 522, 251])}-{rng.randint(100, 103)}-{rng.randint(0, 30):04d}" for _ in range(160)]
    q, p = list(enumerate(made[:30] + ["no code", ""])), list(enumerate(made[30:] * 2))
    want = {}
    for i, a in q:
        rows = [(0.95, -j) for j, b in p if a and a == b]
        if a not in ("no code", ""):
            rows += [(min(0.9, 0.7 + 0.2 * similarity.ratio(a, b) / 100), -j) for j, b in p if a != b and similarity.ratio(a, b) >= 80]
        want[i] = [(-j, round(s, 9)) for s, j in sorted(rows, reverse=True)[:5]]
    got = retrieval.code_search(spark.createDataFrame(q, "qid long, code string"), spark.createDataFrame(p, "id long, code string"), 5).collect()
    found = {i: [] for i, _ in q}
    for r in sorted(got, key=lambda r: (r["qid"], r["rank"])):
        found[r["qid"]].append((r["id"], round(r["score"], 9)))
    assert found == want


def test_section_by_a_similar_name(spark):
    names = [("521-101-0100", "Лабораторное оснащение"), ("521-102-0200", "Прочие приборы"), ("522-103-0100", None)]
    items = [(1, "", "", "лабораторное оснащени", ""), (2, "", "", "совсем другое zzz", ""), (3, "9-9", "", "лабораторное", ""), (4, "", "", "", None)]
    rows = rules.resolve_category(spark.createDataFrame(items, "qid long, category string, label string, name string, description string"), spark.createDataFrame(names, "category string, category_name string")).collect()
    got = {r["qid"]: (r["category"], r["how"]) for r in rows}
    want = {}
    for qid, _, _, name, _ in items[:2]:
        best = max(((similarity.partial_ratio(name, n), c) for c, n in names if n), key=lambda x: x[0])
        want[qid] = (best[1], "name") if best[0] >= 72 else (None, None)
    assert got == want | {3: ("9-9", "item"), 4: (None, None)} and len(rows) == 4


def test_repeated_headers_keep_the_last_column(spark, tmp_path):
    (tmp_path / "b.xlsx").write_bytes(book([["Код", "Цена", "Цена"], ["a", "1", "2"], ["b", "3", None]]))
    data = workbook.records(workbook.read_sheets(spark, str(tmp_path))).collect()
    assert [(r["fields"]["Код"], r["fields"]["Цена"]) for r in sorted(data, key=lambda r: r["row"])] == [("a", "2"), ("b", None)]


@pytest.mark.parametrize("per_range", [7, 1_000_000])
def test_running_sums_over_ranges(spark, per_range):
    rows = [(k, None if k % 11 == 0 else float(k * 37 % 50), k % 5) for k in range(120)]
    df = spark.createDataFrame(rows, "id long, v double, w long")
    got = {r["id"]: r["place"] for r in statistics.numbered(df, "v", ("id",), per_range=per_range).collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    assert got == {r[0]: n for n, r in enumerate(order, 1)}


@pytest.mark.parametrize("per_range", [7, 1_000_000])
def test_numbers_of_nulls_and_one_value(spark, per_range):
    rows = spark.createDataFrame([(k, None if k < 60 else 1.0) for k in range(90)], "id long, v double")
    got = {r["id"]: r["place"] for r in statistics.numbered(rows, "v", ("id",), per_range=per_range).collect()}
    assert got == {k: k - 59 if k >= 60 else k + 31 for k in range(90)}
    alone = statistics.numbered(rows.select("v"), "v", (), per_range=per_range).select("place").collect()
    assert sorted(r["place"] for r in alone) == list(range(1, 91))  # rows that nothing tells apart
    held = statistics.batches(rows.select(F.when(F.col("id") % 9 > 0, F.col("id")).alias("id")), ["id"], 8, per_range=per_range).groupBy("batch").count().collect()
    assert sorted((r["batch"], r["count"]) for r in held) == [(n, 8) for n in range(1, 12)] + [(12, 2)]


def test_auc_of_null_scores_over_ranges(spark):
    rows = spark.createDataFrame([(int(k * 7 % 3 == 0), None if k % 5 == 0 else float(k * 37 % 101)) for k in range(400)], "label int, score double")
    one = statistics.roc_auc(rows, "label", "score").first()
    assert one == statistics.roc_auc(rows, "label", "score", per_range=9).first() and one["positives"] + one["negatives"] == 400


def test_required_columns_and_modes(spark):
    sheet = spark.createDataFrame([("a", "b")], "x string, y string")
    for read in (readers.read_catalog, readers.read_items, readers.read_government_catalog, readers.read_our_items, readers.read_needs, readers.read_price_list):
        with pytest.raises(ValueError):
            read(sheet)
    assert ranking.FAST.engine == "fast_code_tfidf" and ranking.SEMANTIC.candidates == 50
    with pytest.raises(ValueError):
        workflow.add_field(spark.createDataFrame([(1, "net_weight", 10, True)], "source_id long, field_key string, position int, core boolean"), 1, "Net Weight")
