"""Ranking chains, sources, catalog changes and run statistics over the relational tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.operators import catalog, fusion, learning, ranking, statistics, workflow
from ledgermill.operators import retrieval as r
from ledgermill.plans.exports import _LINES, matched_lines
from ledgermill.plans.maintenance import _CODED, coded_parts
from ledgermill.plans.registry import query, table
from ledgermill.plans.search import _FUSED, _TFIDF, fused_pool, tfidf_hits


@query("o177_resorted", _FUSED + " SELECT * FROM (SELECT qid, id, final, coverage, row_number() OVER (PARTITION BY qid ORDER BY coverage DESC, id) AS rank FROM pool) WHERE rank <= 3")
def resorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best of the pool in order of coverage, three of them."""
    return ranking.resort(fused_pool(spark, sf_dir).drop("rank", "new_rank", "rrf"), "coverage", score="final").select("qid", "id", "final", "coverage", "rank")


@query("o206_manual_search", _FUSED + " SELECT qid, id, final, rank FROM pool WHERE rank <= 10 AND id % 6 <> 0")
def manual_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best by raw score; documents that left the catalog since are dropped after the cut."""
    live = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 6 == 0, False).alias("active"))
    return ranking.manual_search(fused_pool(spark, sf_dir).drop("rank", "new_rank"), live).select("qid", "id", "final", "rank")


@query("o103_suspicious", _FUSED + " SELECT qid, id, coverage FROM ro WHERE rank = 1 AND final >= 0.25 AND coverage < 0.6")
def suspicious(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted first candidates of low coverage; thresholds fit these tables."""
    best = fused_pool(spark, sf_dir).where("rank = 1").withColumn("decision", F.when(F.col("final") >= 0.25, "auto_accepted").otherwise("pending"))
    return ranking.suspicious(best, 0.6).select("qid", "id", "coverage")


@query(
    "o173_broken_ties",
    _FUSED
    + """, g AS (SELECT qid, max(rrf) FILTER (new_rank = 1) - max(rrf) FILTER (new_rank = 2) AS margin, max(rrf) FILTER (new_rank = 1) AS top FROM ro GROUP BY qid),
    ch AS (SELECT qid, max(id) AS id FROM ro JOIN g USING (qid) WHERE margin < 0.0005 AND new_rank <= 3 GROUP BY qid), f AS (SELECT ch.qid, ch.id AS chosen, new_rank AS moved FROM ch JOIN ro ON ro.qid = ch.qid AND ro.id = ch.id)
    SELECT ro.qid, ro.id, CASE WHEN ro.id = chosen THEN 1 WHEN new_rank < moved THEN new_rank + 1 ELSE new_rank END AS rank, round(CASE WHEN ro.id = chosen THEN top + 1e-6 ELSE rrf END, 9) AS score FROM ro JOIN g USING (qid) LEFT JOIN f USING (qid)""",
)
def broken_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close first places: of the three contenders a stand-in for the tie-breaker takes the largest id."""
    ranked = fused_pool(spark, sf_dir)
    choices = fusion.ambiguous(ranked).groupBy("qid").agg(F.max("id").alias("id"))
    return ranking.break_tie(ranked, choices).select("qid", "id", F.col("new_rank").alias("rank"), F.round("rrf", 9).alias("score"))


_BLENDED = (
    _TFIDF
    + """, k AS (SELECT benchmark.text AS need, item_id AS qid, t.id, t.cosine, t.rank FROM benchmark LEFT JOIN (SELECT * FROM t WHERE rank <= 3 AND cosine >= 0.05) t ON t.qid = item_id),
    tk AS (SELECT k.*, list_distinct(list_filter(regexp_extract_all(lower(need), '[a-zа-яё0-9]+'), lambda x: length(x) > 1)) AS a, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-zа-яё0-9]+'), lambda x: length(x) > 1)) AS b FROM k LEFT JOIN documents ON doc_id = id),
    bl AS (SELECT qid, id, rank, 0.75::double * cosine + 0.25::double * len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::double AS final FROM tk),
    ty AS (SELECT qid, id, rank, round_even(final, 4) AS score, CASE WHEN final >= 0.2 THEN 'exact-like' WHEN final IS NOT NULL THEN 'related' END AS match_type FROM bl)"""
)


def blended(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("catalog_text"))
    needs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("need_text"))
    best = tfidf_hits(spark, sf_dir).where("cosine >= 0.05")
    return ranking.blend_tokens(needs.join(best.join(docs, "id"), "qid", "left")).select("qid", "id", "rank", "score", "match_type")


@query("o85_blended_scores", _BLENDED + " SELECT * FROM ty")
def blended_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blended(spark, sf_dir)


@query(
    "o155_match_summary",
    _BLENDED
    + """, c AS (SELECT count(DISTINCT qid) AS n, count(DISTINCT qid) FILTER (match_type IS NOT NULL) AS m, count(*) FILTER (match_type = 'exact-like') AS h, count(*) FILTER (match_type = 'related') AS l FROM ty)
    SELECT unnest(['total_needs', 'matched', 'missing', 'matches_with_high_score', 'matches_with_med_score']) AS metric, unnest([n, m, n - m, h, l]) AS value FROM c""",
)
def match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.match_summary(blended(spark, sf_dir))


@query(
    "o22_score_distribution",
    _BLENDED + " SELECT bin::int AS bin, (SELECT count(*) FROM ty WHERE score > CASE bin WHEN 0 THEN -1 WHEN 1 THEN 0.1 WHEN 2 THEN 0.2 ELSE 0.5 END AND score <= CASE bin WHEN 0 THEN 0.1 WHEN 1 THEN 0.2 WHEN 2 THEN 0.5 ELSE 1 END) AS count FROM range(4) AS b(bin)",
)
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgermill.sources.sinks import three_sheets

    return three_sheets(blended(spark, sf_dir))["score_distribution"]


@query(
    "o21_ranked_export",
    _FUSED + """ SELECT 'N' || qid AS "Item Code", benchmark.text AS "Item Name", new_rank AS "Rank", 'D' || id AS "Government Code", documents.lang AS "Product Name", documents.source AS "Brand", final AS "Similarity Score", round_even(final * 100, 1) AS "Confidence (%)", array_to_string(matched_by, ',') AS "Explanation" FROM ro JOIN benchmark ON item_id = qid JOIN documents ON doc_id = id WHERE new_rank <= 3""",
)
def ranked_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgermill.sources.sinks import ranked_export as sink

    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.concat(F.lit("N"), F.col("item_id").cast("string")).alias("item_code"), F.col("text").alias("item_name"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("code"), F.col("lang").alias("name"), F.col("source").alias("brand"))
    rows = fused_pool(spark, sf_dir).where("new_rank <= 3").drop("rank").join(items, "qid").join(docs, "id")
    return sink(rows.withColumns({"rank": F.col("new_rank"), "similarity": F.col("final"), "confidence": F.bround(F.col("final") * 100, 1), "explanation": F.array_join("matched_by", ",")}))


_SOURCES = "WITH s AS (SELECT c_custkey AS source_id, c_name AS name, CASE WHEN c_acctbal < 0 THEN false WHEN c_acctbal < 5000 THEN true END AS enabled, c_custkey % 11 = 0 OR NULL AS archived FROM customer), l AS (SELECT DISTINCT o_custkey % 5 AS project_id, o_custkey AS source_id, o_custkey % 2 = 0 AS included, (o_custkey * 7) % 100 AS sort_order FROM orders)"


def sources_and_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b, k, c = F.col("c_acctbal"), F.col("c_custkey"), F.col("o_custkey")
    s = table(spark, sf_dir, "customer").select(k.alias("source_id"), F.col("c_name").alias("name"), F.when(b < 0, False).when(b < 5000, True).alias("enabled"), F.when(k % 11 == 0, True).alias("archived"))
    links = table(spark, sf_dir, "orders").select((c % 5).alias("project_id"), c.alias("source_id"), (c % 2 == 0).alias("included"), ((c * 7) % 100).alias("sort_order")).distinct()
    return s, links


@query("o106_usable_sources", _SOURCES + " SELECT source_id FROM s WHERE coalesce(enabled, true) AND NOT coalesce(archived, false)")
def usable_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.usable_sources(sources_and_links(spark, sf_dir)[0]).select("source_id")


@query(
    "o202_resolved_sources",
    _SOURCES
    + """, u AS (SELECT * FROM s WHERE coalesce(enabled, true) AND NOT coalesce(archived, false))
    SELECT 'ids' AS how, source_id, NULL::bigint AS place FROM u WHERE source_id IN (3, 5, 8, 9999999) UNION ALL SELECT 'names', source_id, NULL FROM u WHERE name IN ('Customer#000000003', 'Customer#000000004')
    UNION ALL SELECT 'project', source_id, sort_order FROM u JOIN l USING (source_id) WHERE project_id = 2 AND included UNION ALL SELECT 'name', source_id, NULL FROM u WHERE name = 'Customer#000000006'""",
)
def resolved_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, links = sources_and_links(spark, sf_dir)
    asked = {"ids": {"ids": [3, 5, 8, 9999999]}, "names": {"names": ["Customer#000000003", "Customer#000000004"]}, "project": {"project_id": 2}, "name": {"name": "Customer#000000006"}}
    parts = [workflow.resolve_sources(s, links, **a).select(F.lit(how).alias("how"), "source_id", "place") for how, a in asked.items()]
    return reduce(DataFrame.unionByName, parts)


_UPLOADS = "WITH u AS (SELECT o_orderkey AS upload_id, o_orderpriority AS upload_type, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey % 7 END AS project_id FROM orders)"


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("upload_id"), F.col("o_orderpriority").alias("upload_type"), F.when(c % 3 != 0, c % 7).alias("project_id"))


@query(
    "o105_uploads_by_project",
    _UPLOADS + " SELECT 'type' AS how, upload_id FROM u WHERE upload_type = '5-LOW' UNION ALL SELECT 'project', upload_id FROM u WHERE project_id = 4 UNION ALL SELECT 'none', upload_id FROM u WHERE project_id IS NULL AND upload_type = '1-URGENT'",
)
def uploads_by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = uploads(spark, sf_dir)
    asked = {"type": ("5-LOW", None), "project": (None, 4), "none": ("1-URGENT", "none")}
    return reduce(DataFrame.unionByName, [workflow.filter_uploads(u, *a).select(F.lit(how).alias("how"), "upload_id") for how, a in asked.items()])


@query("o207_detached_uploads", _UPLOADS + " SELECT upload_id, CASE WHEN project_id <> 4 THEN project_id END AS project_id FROM u")
def detached_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.detach_project(uploads(spark, sf_dir), 4).select("upload_id", "project_id")


_PRODUCTS = _CODED + ", x AS (SELECT id, name, price, id % 4 <> 0 AS active FROM p)"


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded_parts(spark, sf_dir).select("id", "name", F.col("name").alias("normalized_name"), "price", (F.col("id") % 4 != 0).alias("active"))


@query("o197_deleted_restored", _PRODUCTS + " SELECT id, CASE WHEN id % 6 = 0 THEN false WHEN id % 8 = 0 THEN true ELSE active END AS active FROM x")
def deleted_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = products(spark, sf_dir)
    ids = x.select("id")
    return workflow.set_active(workflow.set_active(x, ids.where("id % 8 = 0"), True), ids.where("id % 6 = 0"), False).select("id", "active")


@query(
    "o197_patched",
    _PRODUCTS + " SELECT id, CASE WHEN id % 5 = 0 THEN 'New-Name ' || id ELSE name END AS name, CASE WHEN id % 5 = 0 THEN 'new name ' || id ELSE name END AS normalized_name, CASE WHEN id % 3 = 0 THEN id + 0.5::double ELSE price END AS price FROM x",
)
def patched(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, k = products(spark, sf_dir), F.col("id").cast("string")
    named = x.where("id % 5 = 0").select("id", F.create_map(F.lit("name"), F.concat(F.lit("New-Name "), k)).alias("fields"))
    priced = x.where("id % 3 = 0").select("id", F.create_map(F.lit("price"), F.concat(k, F.lit(".5"))).alias("fields"))
    return workflow.patch(x, named.unionByName(priced)).select("id", "name", "normalized_name", "price")


@query(
    "o198_replaced_version",
    _LINES + ", x AS (SELECT p_partkey AS id, p_size % 3 AS version_id FROM part) SELECT 'product' AS kind, id, NULL::bigint AS qid FROM x WHERE version_id <> 1 UNION ALL SELECT 'product', id + 1000000, NULL FROM x WHERE version_id = 1 AND id % 2 = 0 UNION ALL SELECT 'match', id, qid FROM m ANTI JOIN (SELECT id FROM x WHERE version_id = 1) USING (id)",
)
def replaced_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 3).alias("version_id"))
    new = x.where("version_id = 1 and id % 2 = 0").withColumn("id", F.col("id") + 1000000)
    p, m = workflow.replace_version(x, new, matched_lines(spark, sf_dir).select("qid", "id"), 1)
    return p.select(F.lit("product").alias("kind"), "id", F.lit(None).cast("long").alias("qid")).unionByName(m.select(F.lit("match").alias("kind"), "id", "qid"))


@query("o199_backfilled", "SELECT count(*) FILTER (p_partkey % 3 = 0 OR p_size % 5 = 0) AS changed FROM part")
def backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, z = F.col("p_partkey"), F.col("p_size")
    p = table(spark, sf_dir, "part").select(k, z, F.when(k % 3 != 0, F.col("p_type")).alias("category"), F.when(z % 5 == 0, "old").otherwise(F.col("p_brand")).alias("category_name"), "p_type", "p_brand")
    return workflow.count_backfilled(p, F.col("p_type"), F.col("p_brand"))


@query(
    "o192_resumed",
    _LINES + ", b AS (SELECT qid, arg_max(id, struct_pack(s := score, i := -id)) AS id, max(score) AS score FROM m GROUP BY qid) SELECT o_orderkey AS qid, o_custkey AS id, 1.0::double AS score, 'вручную' AS decision FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT qid, id, score, CASE WHEN score >= 0.8 THEN 'авто' ELSE 'без совпадения' END FROM b ANTI JOIN (SELECT o_orderkey AS qid FROM orders WHERE o_orderstatus = 'F') USING (qid)",
)
def resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("qid"), F.col("o_custkey").alias("id"), F.lit(1.0).alias("score"), F.lit("вручную").alias("decision"))
    new = r.top_k(matched_lines(spark, sf_dir).drop("rank"), 1).withColumn("decision", F.when(F.col("score") >= 0.8, "авто").otherwise("без совпадения"))
    return workflow.resume(decided, new)


@query(
    "o117_resume_matches",
    "WITH m AS (SELECT l_orderkey AS qid, arg_max(l_partkey, struct_pack(d := l_shipdate, i := l_partkey)) AS id FROM lineitem GROUP BY 1) SELECT qid, id, p_name AS name FROM m JOIN part ON p_partkey = id WHERE p_partkey % 6 <> 0",
)
def resume_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest match of each order with its product; products that are gone leave none."""
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("id"), F.col("l_discount").alias("score"), F.col("l_shipdate").alias("created"))
    return workflow.latest_matches(m, coded_parts(spark, sf_dir).where("id % 6 <> 0")).select("qid", "id", "name")


_FIELDS = "WITH f AS (SELECT DISTINCT p_size AS source_id, p_brand AS field_key, p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AS core FROM part)"


@query("o208_fields", _FIELDS + " SELECT source_id, field_key FROM f WHERE core OR source_id % 2 = 1 UNION ALL SELECT 1, 'net_weight'")
def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of even sources are deleted but for the core ones, and one source gets a new field."""
    f = table(spark, sf_dir, "part").select(F.col("p_size").alias("source_id"), F.col("p_brand").alias("field_key")).distinct()
    f = f.withColumns({"position": F.lit(0), "core": F.col("field_key").isin("Brand#11", "Brand#12", "Brand#13")})
    return workflow.add_field(workflow.drop_fields(f, f.where("source_id % 2 = 0")), 1, " Net Weight").select("source_id", "field_key")


@query("o208_mappings", "SELECT c_nationkey AS source_id, c_name AS excel_header, c_mktsegment AS field_key FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT 3, lower(p_name), p_brand FROM part WHERE p_partkey % 3 <> 0 AND p_size = 7")
def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("source_id"), F.col("c_name").alias("excel_header"), F.col("c_mktsegment").alias("field_key"))
    new = table(spark, sf_dir, "part").where("p_size = 7").select(F.when(F.col("p_partkey") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), F.upper("p_name"))).alias("excel_header"), F.concat("p_brand", F.lit(" ")).alias("field_key"))
    return workflow.replace_mappings(old, 3, new)


_HELD = "WITH r AS (SELECT p_size % 4 AS upload_id, p_partkey AS source_row, p_name AS name, p_retailprice AS price, p_partkey % 3 <> 0 OR NULL AS active, p_partkey % 10 = 0 AS header FROM part)"


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select((F.col("p_size") % 4).alias("upload_id"), k.alias("source_row"), F.col("p_name").alias("name"), F.col("p_name").alias("normalized_name"), F.col("p_retailprice").alias("price"), F.when(k % 3 != 0, True).alias("active"), (k % 10 == 0).alias("header"))


@query("o146_product_counts", _HELD + " SELECT upload_id, count(*) FILTER (coalesce(active, true) AND NOT header) AS product_count, max(source_row) + 1 AS next_source_row FROM r GROUP BY upload_id")
def product_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.product_counts(held(spark, sf_dir))


@query(
    "o209_added_product",
    _HELD + ", n AS (SELECT max(source_row) AS last FROM r WHERE upload_id = 2) SELECT upload_id, source_row, name, price FROM r UNION ALL SELECT 2, last + 1, 'Added-A', 1.5 FROM n UNION ALL SELECT 2, last + 2, 'Added-B', 2.5 FROM n",
)
def added_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows by hand in the newest active upload, behind its last row."""
    known = spark.range(4).select(F.col("id").cast("int").alias("upload_id"), F.col("id").alias("created"), (F.col("id") != 3).alias("active"))
    new = spark.range(2).select(F.when(F.col("id") == 0, "Added-A").otherwise("Added-B").alias("name"), (F.col("id") + 1.5).alias("price"))
    return workflow.add_product(held(spark, sf_dir), known, new).select("upload_id", "source_row", "name", "price")


@query("o148_category_counts", _CODED + ", c AS (SELECT id, CASE WHEN id % 3 <> 0 THEN name END AS name, substr(code, 1, 8) || lpad((CAST(substr(code, 9, 4) AS int) // 100 * 100)::varchar, 4, '0') AS category FROM p) SELECT category, count(*) AS products, arg_min(name, id) FILTER (name IS NOT NULL) AS first_name FROM c GROUP BY 1")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.category_counts(coded_parts(spark, sf_dir).withColumn("name", F.when(F.col("id") % 3 != 0, F.col("name"))))


@query("o100_ilike_search", _CODED + " SELECT id FROM p WHERE name ILIKE '%r_d%' OR code ILIKE '%r_d%' UNION ALL SELECT id FROM p WHERE name ILIKE '%-0012%' OR code ILIKE '%-0012%'")
def ilike_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wildcard in a name, and a part of a code."""
    p = coded_parts(spark, sf_dir)
    return catalog.product_search(p, "R_D").select("id").unionByName(catalog.product_search(p, "-0012").select("id"))


@query(
    "o183_united_ids",
    "SELECT DISTINCT l_orderkey AS qid, l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' OR l_linestatus = 'O'",
)
def united_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("id"), "l_returnflag", "l_linestatus")
    return catalog.union_ids(li.where("l_returnflag = 'R'"), li.where("l_linestatus = 'O'"))


_SCOPED = _LINES + ", a AS (SELECT qid, id FROM m WHERE qid % 3 = 0 AND id % 2 = 0), b AS (SELECT qid, id FROM m WHERE id % 7 = 0)"


@query("o97_scoped_hits", _SCOPED + " SELECT qid, id FROM m WHERE (qid NOT IN (SELECT qid FROM a) OR id % 2 = 0) AND id % 7 <> 0")
def scoped_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowed ids for a third of the requests, and blocked ids for all."""
    m = matched_lines(spark, sf_dir).select("qid", "id")
    return catalog.within_scope(m, m.where("qid % 3 = 0 and id % 2 = 0"), m.where("id % 7 = 0"))


@query("o114_chosen_candidates", _LINES + " SELECT qid, id, p_name AS name FROM m JOIN part ON p_partkey = id WHERE rank = 1 AND flag <> 'A' AND p_partkey % 6 <> 0")
def chosen_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matched_lines(spark, sf_dir).where("rank = 1").select("qid", F.when(F.col("flag") != "A", F.col("id")).alias("selected"))
    return workflow.chosen_candidates(m, coded_parts(spark, sf_dir).where("id % 6 <> 0"))


@query(
    "o115_training_pairs",
    _LINES + ", s AS (SELECT qid, arg_max(id, struct_pack(s := score, i := -id)) AS selected FROM m WHERE flag <> 'A' GROUP BY qid) SELECT m.qid AS feedback_id, m.qid, id, rank, (id = selected AND selected IS NOT NULL)::int AS label FROM m LEFT JOIN s USING (qid) WHERE rank <= 3",
)
def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shown candidates as nested feedback, exploded to labelled pairs."""
    m = matched_lines(spark, sf_dir)
    chosen = m.where("flag <> 'A'").groupBy("qid").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("selected"))
    shown = m.where("rank <= 3").groupBy("qid").agg(F.collect_list(F.struct("id", "rank", "score")).alias("candidates"))
    return learning.training_pairs(shown.join(chosen, "qid", "left").withColumn("feedback_id", F.col("qid")))


@query(
    "o210_features",
    _LINES
    + """, d AS (SELECT m.qid, m.id, o_totalprice / 100 AS a, p_retailprice AS b, CASE WHEN rank <= 2 THEN score END AS kw FROM m JOIN orders ON o_orderkey = qid LEFT JOIN part ON p_partkey = id AND p_partkey % 6 <> 0)
    SELECT qid, id, coalesce(kw, 0) AS keyword, 0.0::double AS fuzzy, CASE WHEN a > 0 AND b > 0 THEN round(abs(a - b) / greatest(a, b), 9) ELSE 1 END AS price_difference, CASE WHEN a > 0 AND b > 0 THEN 1.0 ELSE 0.0 END AS price_available FROM d""",
)
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of pairs, some without scores or without a price."""
    m = matched_lines(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid"), (F.col("o_totalprice") / 100).alias("price_a"))
    p = coded_parts(spark, sf_dir).where("id % 6 <> 0").select("id", F.col("price").alias("price_b"))
    pairs = m.select("qid", "id").join(o, "qid").join(p, "id", "left")
    scores = m.where("rank <= 2").select("qid", "id", F.lit(None).cast("double").alias("embedding"), F.col("score").alias("keyword"), F.lit(None).cast("double").alias("fuzzy"))
    return learning.features(pairs, scores).select("qid", "id", "keyword", "fuzzy", F.round("price_difference", 9).alias("price_difference"), "price_available")


_TRUTH = "WITH c AS (SELECT p_name AS name, min(p_partkey) AS truth FROM part WHERE p_partkey % 10 <> 0 GROUP BY p_name), t AS (SELECT p_partkey + 5000000 AS qid, truth, p_partkey, p_size FROM part JOIN c ON c.name = p_name WHERE p_partkey % 7 = 0)"


@query("o121_ground_truth", _TRUTH + " SELECT qid, truth FROM t")
def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truth(spark, sf_dir)


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    asked = p.where("p_partkey % 7 = 0").select((F.col("p_partkey") + 5000000).alias("qid"), F.col("p_name").alias("name"))
    return statistics.ground_truth(asked, p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_partkey") % 10 == 0).alias("header")))


@query(
    "o159_calibration",
    _TRUTH
    + """, f AS (SELECT qid, truth, CASE WHEN p_size % 4 = 0 THEN -1 WHEN p_size % 4 = 1 THEN NULL ELSE truth END AS id, CASE WHEN p_size % 4 <> 1 THEN p_size / 50.0::double END AS score FROM t), s AS (SELECT c_acctbal / 10000.0::double AS score FROM customer),
    a AS (SELECT list_sort(list(score) FILTER (score IS NOT NULL)) AS l, avg(coalesce(id = truth, false)::int) AS accuracy, avg(score) AS true_mean FROM f), b AS (SELECT list_sort(list(score)) AS l, avg(score) AS sample_mean FROM s),
    x AS (SELECT accuracy, true_mean, a.l[1 + round_even(0.1::double * (len(a.l) - 1), 0)::int] AS true_p10, sample_mean, b.l[1 + round_even(0.9::double * (len(b.l) - 1), 0)::int] AS sample_p90 FROM a, b)
    SELECT round(accuracy, 9) AS accuracy, round(true_mean, 9) AS true_mean, true_p10, round(sample_mean, 9) AS sample_mean, sample_p90, round(true_p10 - sample_p90, 9) AS gap FROM x""",
)
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = table(spark, sf_dir, "part").select((F.col("p_partkey") + 5000000).alias("qid"), F.col("p_size").alias("z"))
    z = F.col("z") % 4
    scored = _truth(spark, sf_dir).join(size, "qid").select("qid", "truth", F.when(z == 0, -1).when(z != 1, F.col("truth")).alias("id"), F.when(z != 1, F.col("z") / 50.0).alias("score"))
    got = statistics.calibration(scored, table(spark, sf_dir, "customer").select((F.col("c_acctbal") / 10000.0).alias("score")))
    return got.select(*[(F.col(c) if c in ("true_p10", "sample_p90") else F.round(c, 9)).alias(c) for c in got.columns])


@query(
    "o129_joined_replies",
    "SELECT s_suppkey AS qid, s_name AS item, CASE WHEN s_suppkey % 4 = 0 THEN 'by place ' || s_suppkey WHEN s_suppkey % 4 <> 3 THEN 'by name ' || s_suppkey END AS value FROM supplier",
)
def joined_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies under the name in capitals, under another name at the same place, or missing."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("qid"), F.col("s_suppkey").alias("pos"), F.col("s_name").alias("item"))
    k = F.col("qid").cast("string")
    named = s.where("qid % 4 in (1, 2)").select((F.col("pos") + 1_000_000).alias("pos"), F.upper("item").alias("item"), F.concat(F.lit("by name "), k).alias("value"))
    placed = s.where("qid % 4 = 0").select("pos", F.lit("other").alias("item"), F.concat(F.lit("by place "), k).alias("value"))
    return workflow.join_replies(s, named.unionByName(placed))


@query(
    "o124_injected_codes",
    _LINES + " SELECT qid, id, score FROM m WHERE rank <= 2 UNION ALL SELECT o_orderkey, o_custkey, 0.0 FROM orders ANTI JOIN (SELECT qid AS o_orderkey, id AS o_custkey FROM m WHERE rank <= 2) USING (o_orderkey, o_custkey) WHERE o_custkey % 4 = 0",
)
def injected_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "orders").where("o_custkey % 4 = 0").select(F.col("o_orderkey").alias("qid"), F.col("o_custkey").alias("id"))
    return workflow.inject_codes(matched_lines(spark, sf_dir).where("rank <= 2"), c)


@query(
    "o92_attribute_blend",
    _LINES + """, w AS (SELECT unnest([0.0, 0.05, 0.1, 0.15, 0.2, 0.3])::double AS w), b AS (SELECT qid, id, rank, w, round((1 - w) * score + w * (id % 11 / 10.0::double), 8) AS blended FROM m, w)
    SELECT qid, id, w, blended, row_number() OVER (PARTITION BY qid, w ORDER BY CASE WHEN w = 0 THEN rank END, blended DESC, rank, id) AS new_rank FROM b""",
)
def attribute_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matched_lines(spark, sf_dir).select("qid", "id", "rank", F.col("score").alias("final"), (F.col("id") % 11 / 10.0).alias("attr"))
    return workflow.blend_attribute(rows).select("qid", "id", "w", "blended", "new_rank")


@query(
    "o142_auto_match_stats",
    _LINES
    + """, b AS (SELECT o_orderkey AS qid, max(score) AS score FROM orders LEFT JOIN m ON m.qid = o_orderkey GROUP BY 1), e AS (SELECT o_orderkey AS qid FROM orders WHERE o_custkey % 9 = 0),
    d AS (SELECT qid, e.qid IS NOT NULL AS exact, score FROM b LEFT JOIN e USING (qid))
    SELECT count(*) AS checked, count(*) FILTER (exact OR score >= 0.88) AS auto_matched, count(*) FILTER (exact) AS exact_matches, count(*) FILTER (NOT exact AND score >= 0.88) AS threshold_matches, count(*) FILTER (NOT exact AND coalesce(score < 0.3, true)) AS auto_rejected,
           count(*) FILTER (NOT exact AND score >= 0.3 AND score < 0.88) AS still_pending FROM d""",
)
def auto_match_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch with exact matches, accepted, rejected and open requests."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid"), "o_custkey")
    best = o.join(r.top_k(matched_lines(spark, sf_dir).drop("rank"), 1), "qid", "left").select("qid", "id", "score")
    exact = o.where("o_custkey % 9 = 0").select("qid", F.col("o_custkey").alias("id"))
    return statistics.auto_match_stats(fusion.decide(best, exact, reject_below=0.3))


_DECISIONS = "CASE event_type WHEN 'click' THEN 'auto_accepted' WHEN 'signup' THEN 'user_selected' WHEN 'error' THEN 'no_match' ELSE event_type END"


@query("o141_decision_counts", f"SELECT user_id, count(*) FILTER (d = 'auto_accepted') AS auto_accepted, count(*) FILTER (d = 'user_selected') AS user_selected, 0::bigint AS manual_search_selected, count(*) FILTER (d = 'no_match') AS no_match, 0::bigint AS auto_rejected, 0::bigint AS exact_match, count(*) AS total FROM (SELECT user_id, {_DECISIONS} AS d FROM events) GROUP BY user_id")
def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    kind = F.when(t == "click", "auto_accepted").when(t == "signup", "user_selected").when(t == "error", "no_match").otherwise(t)
    return statistics.feedback_counts(table(spark, sf_dir, "events").select("user_id", kind.alias("decision")), "user_id")


@query("o158_photo_summary", "SELECT user_id, count(*) FILTER (event_type = 'click') AS found, count(*) FILTER (event_type = 'error') AS missing, count(*) FILTER (event_type NOT IN ('click', 'error')) AS unclear, count(*) AS total FROM events GROUP BY user_id")
def photo_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photo answers folded to their three states and counted."""
    from ledgermill.functions.parse import photo_status

    t = F.col("event_type")
    said = F.when(t == "click", "Найдено").when(t == "error", "Absent").otherwise("maybe")
    return statistics.status_summary(table(spark, sf_dir, "events").select("user_id", photo_status(said, F.lit(None).cast("string"), F.lit(None).cast("string"))["status"].alias("status")), "user_id")


@query("o157_act_totals", "SELECT l_orderkey, round(sum(coalesce(CASE WHEN l_linenumber <> 3 THEN l_quantity END * l_extendedprice, 0)), 2) AS total FROM lineitem GROUP BY l_orderkey")
def act_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("qty"), F.col("l_extendedprice").alias("price"))
    return statistics.act_totals(lines, "l_orderkey").withColumn("total", F.round("total", 2))


@query(
    "o162_source_counts",
    _SOURCES + ", v AS (SELECT DISTINCT o_custkey AS source_id, o_custkey * 10 + o_orderkey % 3 AS version_id, o_orderkey % 3 = 1 AS is_current FROM orders), h AS (SELECT o_custkey * 10 + o_orderkey % 3 AS version_id, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) SELECT source_id, version_id, coalesce(n, 0) AS products FROM s LEFT JOIN (SELECT source_id, version_id FROM v WHERE is_current) USING (source_id) LEFT JOIN h USING (version_id) WHERE NOT coalesce(archived, false)",
)
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, third = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 3
    held_ = o.select(F.col("o_custkey").alias("source_id"), (F.col("o_custkey") * 10 + third).alias("version_id"), (third == 1).alias("is_current"), F.when(F.col("o_orderstatus") == "P", False).alias("active"))
    return statistics.source_counts(sources_and_links(spark, sf_dir)[0], held_.select("source_id", "version_id", "is_current").distinct(), held_)


@query(
    "o214_modes",
    """WITH m AS (SELECT l_partkey AS qid, l_orderkey AS id FROM lineitem GROUP BY ALL), c AS (SELECT qid, count(*) AS n FROM m GROUP BY qid),
    k(mode, engine, candidates, signals) AS (VALUES ('fast', 'fast_code_tfidf', 20, 1), ('balanced', 'balanced_code_tfidf_fuzzy_embed', 50, 2), ('semantic', 'semantic_code_tfidf_fuzzy_embed', 50, 2))
    SELECT mode, engine, sum(least(n, candidates) * signals)::bigint AS kept FROM c, k GROUP BY ALL""",
)
def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of two retrievers' hits, orders of each part, every preset keeps."""
    hits = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("qid"), F.col("l_orderkey").alias("id")).agg(F.max("l_discount").alias("score"))
    rows = None
    for m in (ranking.FAST, ranking.BALANCED, ranking.SEMANTIC):
        for kept in m.signals({"tfidf": hits, "fuzzy": hits}).values():
            one = kept.select(F.lit(m.name).alias("mode"), F.lit(m.engine).alias("engine"))
            rows = one if rows is None else rows.union(one)
    return rows.groupBy("mode", "engine").agg(F.count(F.lit(1)).alias("kept"))


@query(
    "o215_suppliers",
    """WITH i AS (SELECT unnest(['Парта школьная', 'СТУЛ', 'Документ-камера', 'стол']) AS item, unnest(['student desks', 'classroom chairs', 'document cameras', 'default']) AS key, unnest([0, 1, 2, 3]) AS k),
    s AS (SELECT item, key, s_suppkey AS pos, s_name AS name, s_suppkey % 3 = 0 AND k = 1 AS best, row_number() OVER (PARTITION BY item ORDER BY s_suppkey) AS n FROM i JOIN supplier ON s_nationkey % 4 = k)
    SELECT item, key, pos, name, best OR (n = 1 AND NOT bool_or(best) OVER (PARTITION BY item)) AS best FROM s WHERE n <= 2""",
)
def demo_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.createDataFrame([("Парта школьная", 0), ("СТУЛ", 1), ("Документ-камера", 2), ("стол", 3)], "item string, k int").withColumn("key", workflow.supplier_key(F.col("item")))
    s = table(spark, sf_dir, "supplier").join(F.broadcast(items), F.col("s_nationkey") % 4 == F.col("k"))
    rows = s.select("item", "key", F.col("s_suppkey").alias("pos"), F.col("s_name").alias("name"), ((F.col("s_suppkey") % 3 == 0) & (F.col("k") == 1)).alias("best"))
    return workflow.best_suppliers(rows)
