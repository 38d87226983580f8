"""The queries of this subpackage over the driver's tables, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.llm import balls, bpe, collocations, exact_dedup, fastsketch, mixture, packing, rlz, sharding, spotsigs, toxicity, url_rules, warc
from ledgermill.llm.shared import stored, word_count


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Captures as a crawler would have made them of ``pages``, in order of page_id.

    A page whose URL has a query or fragment is a conditional request of the page
    without it, answered by 304; any other page is a full response.  The site
    publishes a path in one version per language section and two-digit path prefix, so
    that the validator of a revisit differs from the stored one where they differ.
    """
    url = F.col("url")
    canonical = warc.canonical_url(url)
    version = F.concat(F.lit("\""), F.substring(F.md5(F.substring_index(canonical, "/", 2)), 1, 8), F.lit("\""))
    revisit = F.coalesce(url.rlike("[?#]"), F.lit(False))
    etag = F.when(url.startswith("https"), F.concat(F.lit("W/"), version)).when(url.rlike("#"), F.lit('"stale"')).otherwise(version)
    headers = F.when(revisit, F.create_map(F.lit("ETag"), etag, F.lit("Date"), F.col("page_id").cast("string"), F.lit("Content-Length"), F.lit("0"))).otherwise(
        F.create_map(F.lit("ETag"), version, F.lit("Date"), F.col("page_id").cast("string"), F.lit("Content-Length"), F.octet_length("html").cast("string"))
    )
    key = F.regexp_replace(F.regexp_replace(url, r"/[^/]*$", "/"), "[?#].*$", "")
    return pages.select(F.col("page_id").alias("capture_id"), key.alias("url"), F.col("page_id").alias("captured"), F.when(revisit, 304).otherwise(200).alias("status"), headers.alias("headers"))


#: Time is page_id here, so no URL has more captures than this in a block.
BLOCK_PAGES = 2048


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(captures_of_pages(_table(spark, sf_dir, "pages")), block=BLOCK_PAGES)
    named = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.select(F.col("capture_id").alias("page_id"), "canonical", "status", "resolution", "source_id", F.array_join(named, "\n").alias("headers"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).withColumn("held_out", toxicity.held_out("doc_id")).select("doc_id", "held_out", "score", "predicted", "weight", "n_words")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


RANKS = "byte_bpe_50k.tiktoken"


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decoded="bytes")
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids, F.sha2("bytes", 256).alias("decoded_sha256"))


#: Length of a packed row.
ROW_TOKENS = 2048
#: Bytes to a token, for the number of shards only.
TOKEN_BYTES = 3


def op5_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed rows of the byte-level BPE ids of all documents; ``ids`` are 16-bit, little-endian.

    The number of shards follows from the bytes of the texts themselves.
    """
    docs = _table(spark, sf_dir, "documents")
    size = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    ids = bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return packing.pack(ids, ROW_TOKENS, shards=max(1, -(-size // (TOKEN_BYTES * packing.SHARD_TOKENS))))


#: The rules of the contract: (verdict, host, path).
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(_table(spark, sf_dir, "pages"), url_rules.rule_table(spark, URL_RULES))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts are read once, for their sizes."""
    docs = _table(spark, sf_dir, "documents")
    sized = stored(docs.select("doc_id", "source", word_count("text").alias("n_words")), "mix-documents")
    return mixture.mix(sized, size_col="n_words").select("doc_id", "size", "source_size", "target", "taken", "times")


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spotsigs.compare_edited(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        spotsigs.as_text(F.col("signatures")).alias("fingerprint"),
        spotsigs.as_text(F.col("edited_signatures")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = rlz.remove_repeats(_table(spark, sf_dir, "documents"))
    return parsed.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fastsketch.near_duplicates(_table(spark, sf_dir, "documents"))


#: Parameters of the contract.
CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024, "3:"


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = balls.ball_kmeans(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", CLUSTERS, ROUNDS, DIMS, SCALE, SEED)
    digests = spark.createDataFrame([(j, balls.centroid_digest(c)) for j, c in enumerate(found.centroids)], "cluster int, centroid_sha256 string")
    rows = found.assigned.join(F.broadcast(digests), "cluster")  # a row per centroid
    return rows.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _kmeans_sql(rounds: int) -> str:
    """Every vector against every centroid, round by round."""
    assigned = """a{0} AS MATERIALIZED (SELECT rid, arg_min(cl, d * {1} + cl) AS cl, min(d) AS d FROM
        (SELECT x.rid, c.cl, sum((x.x - c.x) * (x.x - c.x))::HUGEINT AS d FROM x JOIN c{0} c USING (p) GROUP BY ALL) GROUP BY rid)"""
    moved = """c{0} AS MATERIALIZED (SELECT cl, p, CASE WHEN m.n IS NULL THEN c.x ELSE m.x END AS x FROM c{1} c LEFT JOIN
        (SELECT cl, p, n, ((s - ((s % n) + n) % n) // n)::BIGINT AS x FROM (SELECT cl, p, count(*) AS n, sum(x.x)::HUGEINT AS s FROM x JOIN a{1} USING (rid) GROUP BY ALL)) m USING (cl, p))"""
    steps = [assigned.format(0, CLUSTERS)]
    for t in range(1, rounds + 1):
        steps += [moved.format(t, t - 1), assigned.format(t, CLUSTERS)]
    return f"""
        WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}' || vec_id), v) AS rid, vec_id, v FROM
              (SELECT vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS v FROM embeddings
               WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIMS})),
        x AS MATERIALIZED (SELECT rid, unnest(range({DIMS})) AS p, unnest(v) AS x FROM k),
        c0 AS (SELECT rid - 1 AS cl, p, x FROM x WHERE rid <= {CLUSTERS}),
        {", ".join(steps)},
        i AS (SELECT cl, sum(d)::BIGINT AS cluster_inertia FROM a{rounds} GROUP BY cl),
        h AS (SELECT cl, sha256(string_agg(x::VARCHAR, ',' ORDER BY p)) AS centroid_sha256 FROM c{rounds} GROUP BY cl)
        SELECT vec_id, cl::INTEGER AS cluster, d::BIGINT AS distance, cluster_inertia, (SELECT sum(d)::BIGINT FROM a{rounds}) AS inertia, centroid_sha256
        FROM k JOIN a{rounds} USING (rid) JOIN i USING (cl) JOIN h USING (cl)"""


#: The shards of the contract.
SHARDS = 24


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law is ``bytes``."""
    rows = sharding.shard_documents(_table(spark, sf_dir, "documents"), SHARDS)
    return rows.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents")).drop("words")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_revisits": op1_warc_revisits,
        "op2_toxicity": op2_toxicity,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_token_packing": op5_token_packing,
        "op6_url_filters": op6_url_filters,
        "op7_source_mixing": op7_source_mixing,
        "op8_spotsigs": op8_spotsigs,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_minhash_near_dedup": op10_minhash_near_dedup,
        "op11_ball_kmeans": op11_ball_kmeans,
        "op12_sharding": op12_sharding,
        "op13_collocations": op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op11_ball_kmeans": _kmeans_sql(ROUNDS),
        "op13_collocations": r"""
            WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
            w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
            g AS (SELECT lang, k, list_slice(ws, i, i + k - 1) AS ph FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 5)) AS k) WHERE len(ws) >= k)),
            f AS MATERIALIZED (SELECT lang, k, ph, count(*) AS a FROM g GROUP BY ALL HAVING a >= 30),
            t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
            cut AS (SELECT c.lang, c.k, c.ph, c.a, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a + y.a) AS score, j FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1) c
                    JOIN f x ON x.lang = c.lang AND x.ph = list_slice(c.ph, 1, c.j) JOIN f y ON y.lang = c.lang AND y.ph = list_slice(c.ph, c.j + 1, c.k)),
            low AS (SELECT lang, k, ph, a, arg_min({'l': l, 'r': r, 's': score}, score * 10 + j) AS b FROM cut GROUP BY ALL),
            sub AS (SELECT lang, list_slice(ph, i, i + m - 1) AS ph, max(a) AS longer FROM (SELECT lang, ph, a, m, k, unnest(range(1, k - m + 2)) AS i FROM f, (SELECT unnest(range(2, 4)) AS m) WHERE k > m) GROUP BY ALL),
            kept AS (SELECT low.* FROM low LEFT JOIN sub USING (lang, ph) WHERE coalesce(100::HUGEINT * longer < 80::HUGEINT * a, true)),
            o AS (SELECT lang, array_to_string(ph, ' ') AS phrase, a, b.l AS l, b.r AS r, b.s::BIGINT AS score, row_number() OVER (PARTITION BY lang ORDER BY b.s DESC, a DESC, encode(array_to_string(ph, ' '))) AS rank FROM kept)
            SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN t USING (lang) WHERE rank <= 2000""",
        "op1_warc_revisits": r"""
            WITH k AS (SELECT page_id, url, html, regexp_replace(url, '/[^/]*$', '/') AS u FROM pages),
            c AS (SELECT page_id, url, html, regexp_replace(regexp_replace(u, '^[a-z]+://', ''), '^www\.', '') AS bare FROM k),
            d AS (SELECT page_id, url, html, lower(regexp_extract(bare, '^[^/?]*')) || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS canonical,
                         regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '^www\.', '') AS own FROM c),
            e AS (SELECT *, regexp_matches(url, '[?#]') AS again, chr(34) || substr(md5(regexp_extract(regexp_replace(regexp_replace(own, '[?#].*$', ''), '/+$', ''), '^[^/]*(/[^/]*)?')), 1, 8) || chr(34) AS version FROM d),
            f AS (SELECT page_id, canonical, CASE WHEN again THEN 304 ELSE 200 END AS status, octet_length(encode(html)) AS size,
                         CASE WHEN NOT again THEN version WHEN starts_with(url, 'https') THEN 'W/' || version WHEN contains(url, '#') THEN '"stale"' ELSE version END AS etag FROM e),
            g AS (SELECT f.*, r.page_id AS found, r.etag AS stored, r.size AS stored_size FROM f ASOF LEFT JOIN (SELECT * FROM f WHERE status = 200) r
                  ON f.canonical = r.canonical AND f.page_id > r.page_id),
            h AS (SELECT *, CASE WHEN status = 200 THEN 'response' WHEN found IS NULL THEN 'orphan' WHEN regexp_replace(etag, '^W/', '') = regexp_replace(stored, '^W/', '') THEN 'resolved' ELSE 'mismatch' END AS resolution FROM g)
            SELECT page_id, canonical, status, resolution, CASE WHEN resolution = 'resolved' THEN found END AS source_id,
                   'content-length: ' || CASE WHEN status = 200 THEN size WHEN resolution = 'resolved' THEN stored_size ELSE 0 END || chr(10) || 'date: ' || page_id || chr(10) || 'etag: ' || etag AS headers
            FROM h""",
        "op3_exact_dedup": r"""
            WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
            SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
                   doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
            FROM n""",
        "op9_substring_dedup": r"""
            WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
            win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS k
                    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
            dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM win) WHERE first < doc_id),
            gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 13)) AS j FROM dup)),
            pos AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS word FROM w),
            kept AS (SELECT pos.doc_id, string_agg(word, ' ' ORDER BY pos.j) AS t FROM pos ANTI JOIN gone USING (doc_id, j) GROUP BY pos.doc_id)
            SELECT w.doc_id, len(w.ws) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
            FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)""",
        "op6_url_filters": r"""
            WITH rules(verdict, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'),
                   ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
            u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
            p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
            best AS (SELECT p.page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
                   FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.page_id)
            SELECT p.page_id, p.host, p.path, best.rule, coalesce(best.verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (page_id)""",
    }
