"""Catalog maintenance, workflow statistics and list tools over the relational tables.

Parts stand for catalog products with codes of sections derived from their key, orders
for requests with a status, events for feedback and runs, lineitem for priced lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgermill.functions import codes
from ledgermill.functions.text import latin_tokens, token_set
from ledgermill.operators import catalog, statistics
from ledgermill.plans.registry import query, table
from ledgermill.plans.vocabulary import PART_CLASSES, REQUIRED_PART_CLASSES

_CODED = """
    WITH p AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_type AS model, p_retailprice AS price,
        '521-' || (100 + p_partkey % 7) || '-' || lpad((p_partkey % 1300)::varchar, 4, '0') AS code FROM part)"""


def coded_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    code = F.concat(F.lit("521-"), (100 + k % 7).cast("string"), F.lit("-"), F.lpad((k % 1300).cast("string"), 4, "0"))
    return table(spark, sf_dir, "part").select(k.alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("model"), F.col("p_retailprice").alias("price"), code.alias("code"))


@query(
    "o51_category_codes",
    _CODED
    + " SELECT id, code, substr(code, 1, 8) || lpad((CAST(substr(code, 9, 4) AS int) // 100 * 100)::varchar, 4, '0') AS category, (substr(code, 11, 2) = '00' AND substr(code, 9, 4) <> '0000') AS header, true AS is_code FROM p",
)
def category_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = coded_parts(spark, sf_dir)
    return p.select("id", "code", codes.category_code("code").alias("category"), codes.is_category_header("code").alias("header"), codes.looks_like_code("code").alias("is_code"))


_CATEGORY = "substr(code, 1, 8) || lpad((CAST(substr(code, 9, 4) AS int) // 100 * 100)::varchar, 4, '0')"


@query(
    "o131_category_names",
    _CODED
    + f""", c AS (SELECT id, name, {_CATEGORY} AS category, (substr(code, 11, 2) = '00' AND substr(code, 9, 4) <> '0000') AS header FROM p)
    SELECT category, coalesce(arg_max(name, id) FILTER (header), arg_min(name, id)) AS category_name FROM c GROUP BY category""",
)
def category_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.category_names(coded_parts(spark, sf_dir))


@query("o148_category_rollup", _CODED + f" SELECT {_CATEGORY} AS category, count(*) AS products, arg_min(name, id) AS first_name FROM p GROUP BY 1")
def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = coded_parts(spark, sf_dir)
    return p.groupBy(codes.category_code("code").alias("category")).agg(F.count(F.lit(1)).alias("products"), F.min_by("name", "id").alias("first_name"))


@query(
    "o110_exact_match",
    _CODED
    + """, u AS (SELECT * FROM p WHERE NOT (substr(code, 11, 2) = '00' AND substr(code, 9, 4) <> '0000')),
    r AS (SELECT s_suppkey AS qid, '521-' || (100 + s_suppkey % 9) || '-' || lpad((s_suppkey % 1300)::varchar, 4, '0') AS code, p_name AS name FROM supplier LEFT JOIN part ON p_partkey = s_suppkey * 3),
    a AS (SELECT code, min(id) AS code_id FROM u GROUP BY code), b AS (SELECT name, min(id) AS name_id FROM u GROUP BY name)
    SELECT qid, coalesce(code_id, name_id) AS id, CASE WHEN code_id IS NOT NULL THEN 'code' WHEN name_id IS NOT NULL THEN 'name' END AS by FROM r LEFT JOIN a USING (code) LEFT JOIN b USING (name)""",
)
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = coded_parts(spark, sf_dir).withColumns({"source_row": F.col("id"), "active": F.lit(True), "header": codes.is_category_header("code")})
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))
    s = F.col("s_suppkey")
    asked = table(spark, sf_dir, "supplier").select(s.alias("qid"), F.concat(F.lit("521-"), (100 + s % 9).cast("string"), F.lit("-"), F.lpad((s % 1300).cast("string"), 4, "0")).alias("code"))
    return catalog.exact_match(asked.join(names, F.col("k") == F.col("qid") * 3, "left").select("qid", "code", "name"), p)


# A revision of the catalog: every fifth part is gone, prices rise, every eleventh part is new.
_REVISION = """
    WITH o AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 <> 0 THEN 'K' || p_partkey END AS code, p_name || ' ' || p_partkey AS name, p_retailprice AS price, p_partkey % 6 <> 0 AS active FROM part),
    n AS (SELECT id, code, name, round(price * 1.1::double, 2) AS price FROM o WHERE id % 5 <> 0 UNION ALL SELECT id + 1000000000, 'N' || id, name || ' new', price FROM o WHERE id % 11 = 0),
    ko AS (SELECT *, CASE WHEN code IS NOT NULL THEN 'c:' || code ELSE 'n:' || lower(trim(name)) END AS key FROM o),
    kn AS (SELECT *, CASE WHEN code IS NOT NULL THEN 'c:' || code ELSE 'n:' || lower(trim(name)) END AS key FROM n)"""


def _revision(spark, sf_dir):
    k = F.col("p_partkey")
    old = table(spark, sf_dir, "part").select(
        k.alias("id"), F.when(k % 4 != 0, F.concat(F.lit("K"), k.cast("string"))).alias("code"), F.concat_ws(" ", "p_name", k.cast("string")).alias("name"), F.col("p_retailprice").alias("price"), (k % 6 != 0).alias("active")
    )
    kept = old.where("id % 5 <> 0").select("id", "code", "name", F.round(F.col("price") * 1.1, 2).alias("price"), F.lit(True).alias("active"))
    new = old.where("id % 11 = 0").select(F.col("id") + 1000000000, F.concat(F.lit("N"), F.col("id").cast("string")), F.concat("name", F.lit(" new")), "price", F.lit(True))
    return old, kept.union(new)


@query(
    "o118_catalog_merge",
    _REVISION
    + """ SELECT coalesce(ko.key, kn.key) AS key, coalesce(ko.id, kn.id) AS id, CASE WHEN kn.key IS NOT NULL THEN kn.name ELSE ko.name END AS name, CASE WHEN kn.key IS NOT NULL THEN kn.price ELSE ko.price END AS price,
    CASE WHEN kn.key IS NOT NULL THEN true ELSE ko.active END AS active, CASE WHEN ko.key IS NULL THEN 'inserted' WHEN kn.key IS NULL THEN 'unmatched_existing' WHEN NOT ko.active THEN 'reactivated' ELSE 'updated' END AS outcome FROM ko FULL JOIN kn ON ko.key = kn.key""",
)
def catalog_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.merge_revision(*_revision(spark, sf_dir))


@query(
    "o119_upsert_counts",
    _REVISION
    + " SELECT CASE WHEN ko.key IS NULL THEN 'inserted' WHEN kn.key IS NULL THEN 'deactivated' ELSE 'updated' END AS outcome, count(*) AS n, count(*) FILTER (kn.key IS NOT NULL) AS active FROM ko FULL JOIN kn ON ko.key = kn.key GROUP BY 1",
)
def upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (d.withColumns({"brand": F.lit(""), "model": F.lit("")}) for d in _revision(spark, sf_dir))
    done = catalog.upsert(old, new, deactivate_missing=True)
    return done.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), statistics.count_of(F.col("active")).alias("active"))


@query("o120_deactivate_missing", _REVISION + " SELECT ko.id, ko.key FROM ko ANTI JOIN kn ON ko.key = kn.key")
def deactivate_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.merge_revision(*_revision(spark, sf_dir)).where("outcome = 'unmatched_existing'").select("id", "key")


_LISTS = """
    WITH a AS (SELECT l_partkey AS key, l_orderkey * 10 + l_linenumber AS pos, l_quantity AS qty FROM lineitem WHERE l_returnflag = 'R'),
    b AS (SELECT l_partkey AS key, l_orderkey * 10 + l_linenumber AS pos, l_quantity AS qty FROM lineitem WHERE l_returnflag = 'A'),
    x AS (SELECT key, arg_max(qty, pos) AS qty FROM a GROUP BY key), y AS (SELECT key, arg_max(qty, pos) AS qty FROM b GROUP BY key)"""


@query(
    "o122_list_diff",
    _LISTS
    + " SELECT coalesce(x.key, y.key) AS key, x.qty AS qty_a, y.qty AS qty_b, CASE WHEN y.key IS NULL THEN 'only_a' WHEN x.key IS NULL THEN 'only_b' WHEN x.qty IS NOT DISTINCT FROM y.qty THEN 'matched' ELSE 'mismatched' END AS outcome FROM x FULL JOIN y ON x.key = y.key",
)
def list_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.lit("").alias("name"), F.col("l_quantity").alias("qty"), "l_returnflag")
    return catalog.diff_lists(li.where("l_returnflag = 'R'"), li.where("l_returnflag = 'A'")).select("key", "qty_a", "qty_b", "outcome")


@query("o140_progress", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus = 'F') AS matched, count(*) FILTER (o_orderstatus = 'P') AS no_match FROM orders")
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return statistics.progress(table(spark, sf_dir, "orders"), "o_orderstatus", {"pending": s == "O", "matched": s == "F", "no_match": s == "P"})


@query("o141_feedback_counts", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, (SELECT count(*) FROM events) AS total FROM events GROUP BY event_type")
def feedback_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    total = e.agg(F.count(F.lit(1)).alias("total"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users")).crossJoin(F.broadcast(total))


@query("o145_upload_summary", "SELECT o_custkey, count(*) AS rows, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS done, max(o_orderdate) AS newest FROM orders GROUP BY o_custkey")
def upload_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("rows"), statistics.count_of(s == "O").alias("open"), statistics.count_of(s == "F").alias("done"), F.max("o_orderdate").alias("newest"))


@query("o153_training_readiness", "SELECT count(*) AS total, count(*) FILTER (quality = 1) AS positives, count(*) FILTER (quality = 0) AS negatives, greatest(500 - count(*), 0) AS needed, count(*) >= 500 AS ready FROM labels")
def training_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("quality")
    counts = statistics.progress(table(spark, sf_dir, "labels"), "quality", {"positives": q == 1, "negatives": q == 0})
    return counts.withColumns({"needed": F.greatest(500 - F.col("total"), F.lit(0).cast("long")), "ready": F.col("total") >= 500})


@query(
    "o154_completeness",
    """WITH c AS (SELECT p_partkey, lower(p_name) AS n FROM part), k(category, word) AS (VALUES """
    + ", ".join(f"('{c}', '{w}')" for c, ws in PART_CLASSES.items() for w in ws)
    + """), h AS (SELECT DISTINCT p_partkey, category FROM c JOIN k ON contains(n, word)),
    a AS (SELECT category FROM h UNION ALL SELECT 'Прочее' FROM c ANTI JOIN h USING (p_partkey))
    SELECT category, count(*) AS n FROM a GROUP BY category""",
)
def completeness_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_size").alias("qty"))
    return catalog.completeness(items, PART_CLASSES, REQUIRED_PART_CLASSES)["breakdown"]


_NAME_PAIRS = """
    WITH t AS (SELECT s_suppkey AS id, list_distinct(list_filter(regexp_extract_all(lower(s_name), '[a-zа-яё0-9]+'), lambda x: length(x) > 1)) AS t FROM supplier),
    p AS (SELECT p_partkey AS id, p_name, list_distinct(list_filter(regexp_extract_all(lower(p_name), '[a-zа-яё0-9]+'), lambda x: length(x) > 1)) AS t FROM part)"""


@query(
    "o84_jaccard_names",
    _NAME_PAIRS
    + """, e AS (SELECT DISTINCT p_name AS name, t FROM p), x AS (SELECT a.name AS a, b.name AS b, len(list_intersect(a.t, b.t)) AS c, len(a.t) AS n, len(b.t) AS m FROM e a JOIN e b ON a.name < b.name AND list_has_any(a.t, b.t))
    SELECT a, b, round(c / (n + m - c)::double, 6) AS score FROM x WHERE c / (n + m - c)::double >= 0.3""",
)
def jaccard_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct part names that share words; pairs meet on a shared word only."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().withColumn("t", token_set("name"))
    w = names.select("name", "t", F.explode("t").alias("w"))
    a, b = w.select(F.col("name").alias("a"), F.col("t").alias("ta"), "w"), w.select(F.col("name").alias("b"), F.col("t").alias("tb"), "w")
    pairs = a.join(b, "w").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.first(F.size("ta")).alias("n"), F.first(F.size("tb")).alias("m"))
    return pairs.select("a", "b", F.round(F.col("c") / (F.col("n") + F.col("m") - F.col("c")), 6).alias("score")).where("score >= 0.3")


@query(
    "o65_price_features",
    "SELECT l_orderkey, l_linenumber, CASE WHEN u > 0 AND p > 0 THEN round(abs(u - p) / greatest(u, p), 6) ELSE 1 END AS diff, CASE WHEN u > 0 AND p > 0 THEN 1.0 ELSE 0.0 END AS available FROM (SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_quantity, 0) AS u, p_retailprice AS p FROM lineitem LEFT JOIN part ON p_partkey = l_partkey)",
)
def price_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    li = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
    d = codes.price_difference(F.col("l_extendedprice") / F.nullif("l_quantity", F.lit(0.0)), F.col("p_retailprice"))
    return li.select("l_orderkey", "l_linenumber", F.round(d["diff"], 6).alias("diff"), d["available"].alias("available"))


@query(
    "o156_score_histogram",
    "WITH s AS (SELECT l_discount * 10 AS score FROM lineitem), b AS (SELECT unnest(range(4))::int AS bin), c AS (SELECT CASE WHEN score >= 0 AND score <= 0.1 THEN 0 WHEN score > 0.1 AND score <= 0.2 THEN 1 WHEN score > 0.2 AND score <= 0.5 THEN 2 WHEN score > 0.5 AND score <= 1.0 THEN 3 END AS bin, count(*) AS n FROM s GROUP BY 1) SELECT b.bin, coalesce(n, 0) AS count FROM b LEFT JOIN c USING (bin)",
)
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.histogram(table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("score")))


@query(
    "o159_nearest_rank",
    "WITH v AS (SELECT list_sort(list(c_acctbal)) AS l, count(*) AS n FROM customer) SELECT l[1 + round_even(0.1::double * (n - 1), 0)::int] AS p10, l[1 + round_even(0.5::double * (n - 1), 0)::int] AS p50, l[1 + round_even(0.9::double * (n - 1), 0)::int] AS p90 FROM v",
)
def nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.nearest_rank(table(spark, sf_dir, "customer"), "c_acctbal", [10, 50, 90])


@query(
    "o161_roc_auc",
    """WITH s AS (SELECT quality, n_chars AS s FROM labels JOIN documents USING (doc_id)), r AS (SELECT quality, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::double AS r FROM s),
    t AS (SELECT sum(r) FILTER (quality = 1) AS rs, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS n FROM r) SELECT round((rs - p * (p + 1) / 2.0::double) / nullif(p * n, 0), 6) AS auc, p AS positives, n AS negatives FROM t""",
)
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return statistics.roc_auc(rows, "quality", "n_chars")


@query("o115_json_explode", "SELECT event_id, json_extract(props, '$.k')::bigint AS k, event_type FROM events")
def json_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), "event_type")


@query("o20_export_batches", "SELECT ceil(row_number() OVER (ORDER BY o_orderkey) / 500.0)::bigint AS batch, o_orderkey FROM orders")
def export_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.batches(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 500).select("batch", "o_orderkey")


@query("o180_paging", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 100, 50)


_RUNS = "WITH r AS (SELECT user_id AS run_id, min(ts) AS started, max(ts) AS last_progress, count(*) AS done, 12 AS total FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events)"


@query(
    "o200_stale_runs",
    _RUNS
    + " SELECT run_id, CASE WHEN done >= total THEN 'done' WHEN started < now - INTERVAL 3 HOURS OR last_progress < now - INTERVAL 10 MINUTES THEN 'failed' ELSE 'running' END AS state FROM r, n",
)
def stale_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    runs = e.groupBy(F.col("user_id").alias("run_id")).agg(F.min("ts").alias("started"), F.max("ts").alias("last_progress"), F.count(F.lit(1)).alias("done"), F.lit(12).alias("total"))
    now = e.agg(F.max("ts").alias("now"))
    return statistics.stale(runs.crossJoin(F.broadcast(now)), F.col("now")).select("run_id", "state")


@query("o117_latest_match", "SELECT o_custkey, max(struct_pack(d := o_orderdate, k := o_orderkey)).k AS o_orderkey FROM orders GROUP BY o_custkey")
def latest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest order of each customer; of the same time, the larger key."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(w)).where("n = 1").select("o_custkey", "o_orderkey")


@query("o100_product_search", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%re%' OR p_brand ILIKE '%re%'")
def product_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.col("p_name").ilike("%re%") | F.col("p_brand").ilike("%re%")).select("p_partkey", "p_name")


@query("o157_act_total", "SELECT l_orderkey, round(sum(l_quantity * l_extendedprice), 2) AS total FROM lineitem GROUP BY l_orderkey")
def act_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_quantity") * F.col("l_extendedprice")), 2).alias("total"))


@query("o49_latin_tokens", "SELECT item_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))), ' ') AS tokens FROM benchmark")
def latin_token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(latin_tokens("text")), " ").alias("tokens"))


@query(
    "o182_active_catalog",
    "SELECT c_nationkey, arg_max(c_custkey, struct_pack(a := c_acctbal, k := c_custkey)) AS active, count(*) AS products, coalesce(max(c_custkey), 0) + 1 AS next_row FROM customer GROUP BY c_nationkey",
)
def active_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest of each group, its size and the next free number."""
    return (
        table(spark, sf_dir, "customer")
        .groupBy("c_nationkey")
        .agg(F.max_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("active"), F.count(F.lit(1)).alias("products"), (F.coalesce(F.max("c_custkey"), F.lit(0)) + 1).alias("next_row"))
    )

