"""Not-modified revisits of a web archive, resolved by an as-of join.

A revisit record (HTTP 304) has no body.  It is resolved to the latest earlier full
response of the same canonical URL, if the validators that both carry agree; the
headers of the resolved record are the stored ones, updated by those that a 304
response may update.

Scaling: no payload is moved, only headers and references.  A URL with a third of
all captures is not one group: captures are cut into time blocks, and within (URL,
block) a running last value finds the response.  Only the last response of each block
goes on to a second, much smaller pass over the blocks of a URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a not-modified response may update (RFC 9110, 15.4.5, and RFC 9111, 3.2); fixed values.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "age", "server", "warning")
#: Query parameters that do not select content; fixed values.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "gclid", "fbclid", "sessionid")
#: Captures of one URL within one block of time units are ordered by one task.
BLOCK = 1 << 20


def canonical_url(url: Column) -> Column:
    """Scheme, default port, ``www.``, fragment, tracking parameters and a final slash removed; host in lower case; null stays null."""
    bare = F.regexp_replace(F.regexp_replace(url, r"(?s)#.*$", ""), r"(?i)^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"(?s)^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"(?s)^[^?]*\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).isin(*TRACKING))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise(F.lit("")))


def _folded(headers: Column) -> Column:
    """Header names in lower case; of names that differ in case only, the last value stays."""
    pairs = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(pairs, lambda e: e["key"]))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(pairs, lambda e: e["key"] == k), -1)["value"]))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def validators_agree(stored_headers: Column, new_headers: Column) -> Column:
    """Weak comparison of ETags if both have one, else equality of Last-Modified if both have one, else true."""
    a, b = stored_headers["etag"], new_headers["etag"]
    c, d = stored_headers["last-modified"], new_headers["last-modified"]
    return F.when(a.isNotNull() & b.isNotNull(), _weak(a) == _weak(b)).when(c.isNotNull() & d.isNotNull(), F.trim(c) == F.trim(d)).otherwise(F.lit(True))


def merged_headers(stored_headers: Column, new_headers: Column) -> Column:
    """The stored headers with the permitted ones of the not-modified response over them."""
    update = F.map_filter(new_headers, lambda k, v: k.isin(*PERMITTED))
    return F.map_concat(F.map_filter(stored_headers, lambda k, v: ~F.map_contains_key(update, k)), update)


def resolve_revisits(captures: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per capture, resolved.

    ``captures``: capture_id, url, captured (long, in time units), status (int),
    headers (map).  A capture of status 200 is a full response, one of 304 a revisit.
    Returns capture_id, canonical, status, resolution, source_id, headers, where
    resolution is ``response`` (as it is), ``resolved``, ``mismatch`` (the latest earlier
    response has other validators), ``orphan`` (none earlier) or ``other`` (any other status).

    Edge cases: of captures at the same time, the smaller capture_id is the earlier one;
    null times come first; a null URL resolves nothing (orphan); null headers count as
    none; repeated rows give repeated results; further columns are ignored; an empty
    table gives an empty result.
    """
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    rows = captures.select(
        "capture_id",
        canonical_url(F.col("url")).alias("canonical"),
        F.col("captured").cast("long").alias("captured"),
        "status",
        F.coalesce(_folded(F.col("headers")), none).alias("headers"),
    ).withColumn("part", F.coalesce(F.floor(F.col("captured") / block), F.lit(-(2**62))))
    response = F.when(F.col("status") == 200, F.struct(F.col("capture_id").alias("source_id"), F.col("headers").alias("found")))
    order = [F.col("captured").asc_nulls_first(), F.col("capture_id").asc_nulls_first()]
    inside = Window.partitionBy("canonical", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.last(response, ignorenulls=True).over(inside))

    place = F.struct(F.col("captured").isNotNull().alias("k"), "captured", F.col("capture_id").isNotNull().alias("i"), "capture_id")
    last = rows.where("status = 200 and canonical is not null").groupBy("canonical", "part").agg(F.max_by(F.struct(F.col("capture_id").alias("source_id"), F.col("headers").alias("found")), place).alias("last"))
    blocks = rows.where("canonical is not null").select("canonical", "part").distinct().join(last, ["canonical", "part"], "left")
    before = Window.partitionBy("canonical").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("far", F.last("last", ignorenulls=True).over(before)).where("far is not null").select(F.col("canonical").alias("c"), F.col("part").alias("p"), "far")
    found = near.join(carried, (F.col("canonical") == F.col("c")) & (F.col("part") == F.col("p")), "left").withColumn("base", F.when(F.col("canonical").isNotNull(), F.coalesce("near", "far")))

    agrees = validators_agree(F.col("base.found"), F.col("headers"))
    resolution = (
        F.when(F.col("status") == 200, "response")
        .when(F.coalesce(F.col("status") != 304, F.lit(True)), "other")
        .when(F.col("base").isNull(), "orphan")
        .when(agrees, "resolved")
        .otherwise("mismatch")
    )
    done = found.withColumn("resolution", resolution)
    return done.select(
        "capture_id",
        "canonical",
        "status",
        "resolution",
        F.when(F.col("resolution") == "resolved", F.col("base.source_id")).alias("source_id"),
        F.when(F.col("resolution") == "resolved", merged_headers(F.col("base.found"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
    )
