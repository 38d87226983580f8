"""Text functions, fuzzy names, rules, rankers and the match model over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.functions import codes, parse, text
from ledgermill.operators import learning, ranking, retrieval, rules, setjoin
from ledgermill.plans.maintenance import coded_parts
from ledgermill.plans.registry import query, table
from ledgermill.plans.search import fused_pool
from ledgermill.sources.store import stored


@query(
    "o30_clean_text",
    r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(trim(text)), '[^a-z0-9а-яё\s]', ' ', 'g'), '\s+', ' ', 'g')), '\bpcs?\b', 'pcs', 'g'), '\s+', ' ', 'g'))) AS clean FROM documents",
)
def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean_text("text")).alias("clean"))


@query("o36_normalize_text")
def normalized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_text("text")).alias("normalized"))


@query("o34_numbers", "SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS number, round(l_extendedprice, 2) AS plain FROM lineitem")
def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written with grouping commas, read back by two of the number readers."""
    li = table(spark, sf_dir, "lineitem").withColumn("t", F.format_number("l_extendedprice", 2))
    return li.select("l_orderkey", "l_linenumber", text.to_number("t").alias("number"), text.to_float("t").alias("plain"))


@query("o47_list_lines", "SELECT p_partkey AS key, 'K' || p_partkey AS code, trim(p_name) AS name, p_size::double AS qty FROM part")
def list_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("[K"), F.col("p_partkey").cast("string"), F.lit("] "), F.col("p_name"), F.lit(" x"), F.col("p_size").cast("string"))
    parsed = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), text.parse_list_line(line).alias("l"))
    return parsed.select("key", F.col("l.code").alias("code"), F.col("l.name").alias("name"), F.col("l.qty").alias("qty"))


@query("o59_reply_arrays", "SELECT event_id, json_extract(props, '$.k')::bigint AS k FROM events")
def reply_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies with a fenced array, made of the events' properties."""
    reply = F.concat(F.lit("Here you are:\n```json\n["), F.col("props"), F.lit("]\n```\nDone."))
    return table(spark, sf_dir, "events").select("event_id", F.get(parse.json_array(reply, "array<struct<k:bigint>>"), F.lit(0))["k"].alias("k"))


@query(
    "o58_act_lines",
    "SELECT l_orderkey, l_linenumber, 'part ' || l_partkey AS name, l_quantity::int::varchar AS qty, l_orderkey + 100 AS price FROM lineitem",
)
def act_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.lit(" x"), F.col("l_quantity").cast("int").cast("string"), F.lit(", "), (F.col("l_orderkey") + 100).cast("string"))
    parsed = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", parse.act_line(line).alias("a"))
    return parsed.select("l_orderkey", "l_linenumber", F.col("a.name").alias("name"), F.col("a.qty").alias("qty"), F.col("a.price").cast("long").alias("price"))


def label_requests(spark, sf_dir):
    """Every hundredth part as a request by its label (name, brand, type), the first two letters swapped; all parts as the catalog."""
    label = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), label.alias("name"))
    typo = F.concat(F.substring("name", 2, 1), F.substring("name", 1, 1), F.substring("name", 3, 1_000_000))
    return parts.where("id % 100 = 0").select(F.col("id").alias("qid"), typo.alias("name")), parts


@query("o71_fuzzy_search")
def fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fuzzy_search(*label_requests(spark, sf_dir), 5)


@query("o78_fuzzy_names")
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fuzzy_names(*label_requests(spark, sf_dir), 5)


@query("o86_name_similarity")
def name_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different part labels from a likeness of 0.8 on, of class representatives."""
    return setjoin.similar_names(label_requests(spark, sf_dir)[1], 0.8)


@query("o86_name_classes", "SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY regexp_replace(lower(p_name || ' ' || p_brand || ' ' || p_type), '[^a-z0-9]+', ' ', 'g')) AS rep FROM part")
def name_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which labels are one after cleaning."""
    return setjoin.name_classes(label_requests(spark, sf_dir)[1]).select("id", "rep")


def list_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, id, score, item_name, name, item_code, code): the list tool's candidates of every hundredth part by its misspelt label."""
    asked, parts = label_requests(spark, sf_dir)
    coded = coded_parts(spark, sf_dir).select("id", "code")
    hits = retrieval.fuzzy_search(asked, parts, 25).drop("rank")
    rows = hits.join(asked.withColumnRenamed("name", "item_name"), "qid").join(parts, "id").join(coded, "id").join(coded.select(F.col("id").alias("qid"), F.col("code").alias("item_code")), "qid")
    return rows.select("qid", "id", "score", "item_name", "name", "item_code", "code")


@query("o88_field_aware")
def field_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.field_aware(list_pool(spark, sf_dir)).select("qid", "id", F.round("score", 6).alias("score"))


@query("o178_list_chain")
def list_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain: wide pool, code matches of the catalog, filter, rescoring, five best."""
    pool = list_pool(spark, sf_dir)
    asked, parts = label_requests(spark, sf_dir)
    coded = coded_parts(spark, sf_dir).select("id", "code")
    mine = asked.withColumnRenamed("name", "item_name").join(coded.select(F.col("id").alias("qid"), F.col("code").alias("item_code")), "qid")
    equal = mine.join(coded.join(parts, "id"), F.col("item_code") == F.col("code")).withColumn("score", F.lit(0.0)).select(*pool.columns)
    return ranking.list_candidates(pool, equal).select("qid", "id", F.round("score", 6).alias("score"), "code_matched", "rank")


@query("o80_code_search")
def code_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's code against the parts' codes; similar codes only of those that have no equal one."""
    p = coded_parts(spark, sf_dir)
    s = F.col("s_suppkey")
    asked = table(spark, sf_dir, "supplier").select(s.alias("qid"), F.concat(F.lit("521-"), (100 + s % 9).cast("string"), F.lit("-"), F.lpad((s % 1300).cast("string"), 4, "0")).alias("code"))
    return retrieval.code_search(asked, p, 5)


@query("o98_rule_filter")
def rule_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code candidates of the suppliers after the deterministic rules and the name check."""
    p = coded_parts(spark, sf_dir).withColumn("category", codes.category_code("code"))
    s = F.col("s_suppkey")
    asked = table(spark, sf_dir, "supplier").select(s.alias("qid"), F.col("s_name").alias("item_name"), F.concat(F.lit("521-"), (100 + s % 9).cast("string"), F.lit("-"), F.lpad((s % 1300).cast("string"), 4, "0")).alias("item_code"))
    hits = retrieval.code_search(asked.withColumnRenamed("item_code", "code"), p, 5).select("qid", "id", "score", "exact")
    rows = hits.join(asked, "qid").join(p.select("id", "name", "code", "category"), "id")
    rows = rows.select("qid", "id", "score", F.lit("code").alias("note"), F.lit(False).alias("code_matched"), "item_code", "code", codes.category_code("item_code").alias("item_category"), "category", F.lit(False).alias("blocked"), "item_name", "name")
    return rules.adjust_by_name(rules.filter_candidates(rows)).select("qid", "id", "score", "note", "code_matched")


@query("o89_heuristic_rank")
def heuristic_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("item_name"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("name"))
    pool = fused_pool(spark, sf_dir).select("qid", "id", F.col("final").alias("similarity"))
    empty = {c: F.lit("") for c in ("item_description", "brand", "model", "specs", "description")}
    asked = retrieval.small(pool.join(items, "qid"))  # so that no text of the catalog is dealt
    return rules.heuristic_rank(asked.join(docs, "id").withColumns(empty)).select("qid", "id", "confidence", "explanation")


@query("o203_item_categories")
def item_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgermill.operators.catalog import category_names

    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("qid"), F.lit("").alias("category"), F.col("p_type").alias("label"), F.col("p_name").alias("name"), F.lit("").alias("description"))
    return rules.resolve_category(items, category_names(coded_parts(spark, sf_dir)))


@query("o211_match_model")
def match_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability that a shown candidate is the one meant, by boosted trees on the sub-scores and prices of match pairs.

    Feedback as reviewers of misspelt requests would leave it: of the pool of each
    hundredth part the part itself is selected, the others were shown in vain.
    """
    from ledgermill.plans.hybrid import labelled_search

    pool = stored(labelled_search(spark, sf_dir).candidates(10, 10), "pool")
    shown = F.array_sort(F.collect_list(F.struct("id", "rank", F.col("final").alias("score"))))  # ten a request
    feedback = pool.groupBy("qid").agg(shown.alias("candidates")).select(F.col("qid").alias("feedback_id"), "qid", F.col("qid").alias("selected"), "candidates")
    price = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"))
    pairs = learning.training_pairs(feedback).join(price.withColumnRenamed("price", "price_b"), "id").join(price.select(F.col("id").alias("qid"), (F.col("price") * 1.02).alias("price_a")), "qid")
    rows = learning.features(pairs, pool.select("qid", "id", "embedding", "keyword", "fuzzy")).withColumn("pair", F.concat_ws("-", "qid", "id"))
    split = stored(learning.stratified_split(stored(rows, "pairs"), "pair"), "split")  # read by every tree
    model = learning.train(split.where("not is_test"))
    return learning.predict(model, split).select("qid", "id", "label", "is_test", F.round("probability", 6).alias("probability"))
