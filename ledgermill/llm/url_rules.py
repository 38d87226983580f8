"""Host and path rules for URLs, indexed by their rarest literal token.

A rule is a host and a path prefix; in the path ``*`` stands for any characters.  It
fits its host and all subdomains, if the URL's path starts with the rule's path.

Method: each rule is cut into its literal tokens (whole host labels, whole path
segments); each is filed under the one that fewest URLs contain.  A URL's tokens
fetch the rules filed under them, and only those run their regular expression.
A rule without a whole token is filed under ``*`` and runs on every URL.

Scaling: only DataFrame expressions.  Rules are counted first.  The token counts are
combined before the shuffle and restricted to tokens of rules, which are broadcast up to
``BROADCAST_RULES`` rules.  Up to ``INLINE_RULES`` rules the index is one map in the
projection over the URLs, which are not shuffled at all.  Beyond that the URLs' tokens
meet the index in a join (a broadcast one up to ``BROADCAST_RULES``), and a URL's rows
come together again by a row number, after partial aggregation; ``*`` is no key of it,
so a key has more rows than others only if its token is frequent, which the rarest
token of a rule seldom is, and such a partition of a left join is one that Spark splits.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules up to which the index is a map in the projection, and up to which it is broadcast.
INLINE_RULES = 256
BROADCAST_RULES = 50_000

_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _SMALL)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _tokens(host: Column, path: Column) -> Column:
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    # only segments that a slash ends are whole whatever follows
    segments = F.transform(F.split(F.regexp_replace(path, r"[^/]*$", ""), "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(F.array(F.lit("*")), labels, F.filter(segments, lambda x: x != "p:")))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(rule, verdict, regex, tokens) of (verdict, host, path) triples."""
    given = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
    none = "array<struct<verdict:string,host:string,path:string>>"
    table = spark.range(1).select(F.inline(F.array(*given).cast(none)))  # a plan of known size
    quoted = F.transform(F.split(F.col("path"), r"\*"), lambda x: F.concat(F.lit("\\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    literal = F.filter(_tokens(F.col("host"), F.col("path")), lambda x: ~F.contains(x, F.lit("*")) & (x != "h:"))
    return table.select(
        F.concat("host", "path").alias("rule"),
        "verdict",
        F.concat(F.lit("(?s)^(?:[^/]*\\.)?\\Q"), F.replace(F.col("host"), F.lit("\\E"), F.lit("")), F.lit("\\E"), F.array_join(quoted, "[^?#]*")).alias("regex"),
        F.when(F.size(literal) > 0, literal).otherwise(F.array(F.lit("*"))).alias("tokens"),
    )


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """``keep`` columns, host, path, rule and verdict of every row.

    The longest rule that fits wins (of equal length: ``allow`` before ``block``, then
    the smaller one); rule is null and verdict ``default`` where none fits.

    Edge cases: a null URL or one without ``://`` has empty host and path and fits
    only rules of an empty host; repeated rows and null ids are judged row by row;
    no rules: all get ``default``; an empty table gives an empty result.
    """
    url = F.col(url_col)
    rows = pages.select(*[F.col(c).alias(f"k_{c}") for c in keep], host_of(url).alias("host"), path_of(url).alias("path"), F.monotonically_increasing_id().alias("row"))
    n_rules = rules.count()
    small = F.broadcast if n_rules <= BROADCAST_RULES else lambda df: df
    own_tokens = _tokens(F.col("host"), F.col("path"))
    wanted = rules.select("rule", F.explode("tokens").alias("token"))
    tokens = rows.select(F.explode(own_tokens).alias("token"))
    seen = tokens.join(small(wanted.select("token").distinct()), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token"))
    # longest first, then allow before block
    rank = F.struct(F.length("rule").alias("size"), (F.col("verdict") == "allow").alias("allows"), "rule", "verdict", "regex")
    index = wanted.join(small(seen), "token", "left").groupBy("rule").agg(rarest.alias("token")).join(small(rules.drop("tokens")), "rule").select("token", rank.alias("filed"))
    url_fits = lambda r: F.rlike(F.concat("host", "path"), r["regex"])
    if n_rules <= INLINE_RULES:
        by_token = index.groupBy("token").agg(F.collect_list("filed").alias("filed"))
        inline = by_token.agg(F.map_from_entries(F.collect_list(F.struct("token", "filed"))).alias("filed"))
        candidates = F.flatten(F.transform(own_tokens, lambda t: F.coalesce(F.try_element_at(F.col("filed"), t), F.array().cast("array<struct<size:int,allows:boolean,rule:string,verdict:string,regex:string>>"))))
        fetched = rows.withColumn("filed", inline.scalar()).withColumn("best", F.array_max(F.filter(candidates, url_fits)))
    else:
        always = index.where("token = '*'").agg(F.collect_list("filed").alias("filed"))
        carried = [*[f"k_{c}" for c in keep], "host", "path"]
        fits = F.expr("concat(host, path) rlike filed.regex")
        fetched = (
            rows.withColumn("token", F.explode(F.filter(own_tokens, lambda t: t != "*")))
            .join(small(index.where("token <> '*'")), "token", "left")
            .groupBy("row", *carried)
            .agg(F.max(F.when(fits, F.col("filed"))).alias("best"))
            .withColumn("filed", always.scalar())
            .withColumn("best", F.greatest("best", F.array_max(F.filter("filed", url_fits))))
        )
    return fetched.select(
        *[F.col(f"k_{c}").alias(c) for c in keep],
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
