"""Catalog maintenance: exact matches, merges, upserts, diffs, versions, categories, completeness.

All are equi-joins on business keys; duplicates of a key are settled by a rank before
the join, so that no join multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.functions.codes import category_code, classify_item, is_category_header
from ledgermill.sources.store import stored


def first_per(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``; null keys are left out."""
    return df.where(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def exact_match(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """(qid, id, by): equal code first, else equal name; the smallest source_row of several wins.

    ``requests``: (qid, code, name); ``catalog``: (id, code, name, source_row, active, header).
    """
    usable = catalog.where("active and not header")
    by_code = first_per(usable, "code", [F.col("source_row"), F.col("id")]).select("code", F.col("id").alias("code_id"))
    by_name = first_per(usable, "name", [F.col("source_row"), F.col("id")]).select("name", F.col("id").alias("name_id"))
    found = requests.join(by_code, "code", "left").join(by_name, "name", "left")
    return found.select("qid", F.coalesce("code_id", "name_id").alias("id"), F.when(F.col("code_id").isNotNull(), "code").when(F.col("name_id").isNotNull(), "name").alias("by"))


def merge_revision(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(key, id, name, price, active, outcome) of a revised catalog.

    Key is the code, or the normalised name of rows without one; rows with a code match
    by code only.  Outcome: updated, reactivated, inserted or unmatched_existing.
    Both: (id, code, name, price, active); the last duplicate of a key stands.
    """
    key = F.when(F.col("code").isNotNull(), F.concat(F.lit("c:"), "code")).otherwise(F.concat(F.lit("n:"), F.lower(F.trim("name"))))
    old = first_per(existing.withColumn("key", key), "key", [F.desc("id")])
    new = first_per(incoming.withColumn("key", key), "key", [F.desc("id")])
    o, n = old.alias("o"), new.alias("n")
    outcome = F.when(F.col("o.key").isNull(), "inserted").when(F.col("n.key").isNull(), "unmatched_existing").when(~F.col("o.active"), "reactivated").otherwise("updated")
    pick = lambda c: F.when(F.col("n.key").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return o.join(n, F.col("o.key") == F.col("n.key"), "full").select(
        F.coalesce("o.key", "n.key").alias("key"),
        F.coalesce("o.id", "n.id").alias("id"),
        pick("name").alias("name"),
        pick("price").alias("price"),
        F.when(F.col("n.key").isNotNull(), True).otherwise(F.col("o.active")).alias("active"),
        outcome.alias("outcome"),
    )


def upsert(existing: DataFrame, incoming: DataFrame, deactivate_missing: bool = False) -> DataFrame:
    """(key, name, price, active, outcome): by code, else by name, brand and model in lower case.

    Outcome: updated, inserted, kept or, with ``deactivate_missing``, deactivated.
    """
    part = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    key = F.when(F.coalesce(F.trim("code"), F.lit("")) != "", F.concat(F.lit("c:"), F.trim("code"))).otherwise(F.concat_ws("|", F.lit("n:"), part("name"), part("brand"), part("model")))
    old = first_per(existing.withColumn("key", key), "key", [F.desc("id")]).alias("o")
    new = first_per(incoming.withColumn("key", key), "key", [F.desc("id")]).alias("n")
    there = F.col("n.key").isNotNull()
    outcome = F.when(F.col("o.key").isNull(), "inserted").when(there, "updated").otherwise("deactivated" if deactivate_missing else "kept")
    return old.join(new, F.col("o.key") == F.col("n.key"), "full").select(
        F.coalesce("o.key", "n.key").alias("key"),
        F.when(there, F.col("n.name")).otherwise(F.col("o.name")).alias("name"),
        F.when(there, F.col("n.price")).otherwise(F.col("o.price")).alias("price"),
        F.when(there, True).otherwise(F.lit(not deactivate_missing) & F.col("o.active")).alias("active"),
        outcome.alias("outcome"),
    )


def diff_lists(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, name_a, name_b, qty_a, qty_b, outcome) of two lists (pos, key, name, qty); of equal keys the last row stands."""
    x, y = first_per(a, "key", [F.desc("pos")]).alias("a"), first_per(b, "key", [F.desc("pos")]).alias("b")
    outcome = F.when(F.col("b.key").isNull(), "only_a").when(F.col("a.key").isNull(), "only_b").when(F.col("a.qty").eqNullSafe(F.col("b.qty")), "matched").otherwise("mismatched")
    return x.join(y, F.col("a.key") == F.col("b.key"), "full").select(
        F.coalesce("a.key", "b.key").alias("key"), F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b"), F.col("a.qty").alias("qty_a"), F.col("b.qty").alias("qty_b"), outcome.alias("outcome")
    )


def assign_greedily(pairs: DataFrame) -> DataFrame:
    """(group, a, b, score): each ``a`` in order of ``pos`` takes its best ``b`` that no earlier one took.

    ``pairs``: (group, a, pos, b, score), a position an ``a``.  Worked out in rounds of
    proposals: every ``a`` asks the best ``b`` that no earlier one holds, every ``b`` holds
    the earliest that asks.  What one in order would take is the only outcome in which
    nobody asks anew, so the rounds end there; in each round the first ``a`` without a
    settled ``b`` settles, and usually most do.
    """
    left, held, before = stored(pairs.dropDuplicates(["group", "a", "b"]), "pairs"), None, -1
    while True:
        if held is not None:
            taken = held.select("group", "b", F.col("pos").alias("first"))
            left = stored(left.join(taken, ["group", "b"], "left").where(F.col("first").isNull() | (F.col("pos") <= F.col("first"))).drop("first"), "pairs")
        asked = left.groupBy("group", "a").agg(F.min(F.struct((-F.col("score")).alias("s"), "b", "pos")).alias("best"))
        asked = stored(asked.select("group", "a", F.col("best.b").alias("b"), F.col("best.pos").alias("pos"), (-F.col("best.s")).alias("score")), "asked")
        held = stored(asked.groupBy("group", "b").agg(F.min_by(F.struct("a", "pos", "score"), "pos").alias("h")).select("group", "b", "h.*"), "held")
        if asked.count() == held.count():
            return held.select("group", "a", "b", "score")


def category_names(products: DataFrame) -> DataFrame:
    """(category, category_name): of header rows the last, else the first product's name, in order of id."""
    named = products.select("id", category_code("code").alias("category"), is_category_header("code").alias("header"), F.nullif(F.trim("name"), F.lit("")).alias("name")).where("category is not null and name is not null")
    return named.groupBy("category").agg(F.coalesce(F.max_by(F.when(F.col("header"), F.col("name")), F.when(F.col("header"), F.col("id"))), F.min_by("name", "id")).alias("category_name"))


def completeness(items: DataFrame, vocabulary: dict[str, list[str]], required: list[str]) -> dict[str, DataFrame]:
    """Breakdown by class, missing required classes, items without quantity and repeated keys of (key, name, qty)."""
    classed = items.withColumn("category", F.explode(classify_item("name", vocabulary)))
    breakdown = classed.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    needed = items.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in required])).alias("category"))
    return {
        "breakdown": breakdown,
        "missing": needed.join(breakdown, "category", "left_anti"),
        "no_quantity": items.where("qty is null"),
        "duplicates": items.groupBy("key").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("n")).where("n > 1"),
    }


def indexable(products: DataFrame) -> DataFrame:
    """Rows that an index takes in: no group header (header), and no section header by its code."""
    return products.where(~F.coalesce("header", F.lit(False)) & ~is_category_header("code"))


def index_scope(records: DataFrame, uploads: DataFrame, project_id=None, upload_id=None) -> DataFrame:
    """The active, indexable records of one upload, of a project's uploads or of all; none at all is an error."""
    found = indexable(records.where(F.coalesce("active", F.lit(True))))
    if upload_id is not None:
        found = found.where(F.col("upload_id") == upload_id)
    elif project_id is not None:
        found = found.join(uploads.where(F.col("project_id") == project_id).select("upload_id").distinct(), "upload_id", "left_semi")
    if found.isEmpty():
        raise ValueError("nothing to index in this scope")
    return found


def product_search(products: DataFrame, text: str) -> DataFrame:
    """Products whose name or code contains the text in any case; ``%`` and ``_`` in it are wildcards."""
    return products.where(F.col("name").ilike(f"%{text}%") | F.col("code").ilike(f"%{text}%"))


def union_ids(*lists: DataFrame) -> DataFrame:
    """(qid, id) of any list, once each."""
    out = lists[0].select("qid", "id")
    for more in lists[1:]:
        out = out.unionByName(more.select("qid", "id"))
    return out.distinct()


def category_counts(products: DataFrame) -> DataFrame:
    """(category, products, first_name): products by section, with the first name that is not null."""
    named = products.withColumn("category", category_code("code"))
    return named.groupBy("category").agg(F.count(F.lit(1)).alias("products"), F.min_by("name", F.when(F.col("name").isNotNull(), F.col("id"))).alias("first_name"))


def current_products(products: DataFrame, versions: DataFrame, version=None) -> DataFrame:
    """Active (or unmarked) products of a given version, else of each source's current one; of sources without one, all."""
    if version is not None:
        return products.where(F.coalesce("active", F.lit(True)) & (F.col("version_id") == version))
    now = versions.where("is_current").select("source_id", F.col("version_id").alias("current"))
    return products.where(F.coalesce("active", F.lit(True))).join(now, "source_id", "left").where("current is null or version_id = current").drop("current")


def within_scope(hits: DataFrame, allowed: DataFrame | None, blocked: DataFrame | None) -> DataFrame:
    """Hits (qid, id) in ``allowed`` (a request without any allowed id is unrestricted) and not in ``blocked``."""
    if allowed is not None:
        ask = allowed.select("qid").distinct().withColumn("restricted", F.lit(True))
        marked = allowed.select("qid", "id").distinct().withColumn("ok", F.lit(True))
        hits = hits.join(ask, "qid", "left").join(marked, ["qid", "id"], "left").where("restricted is null or ok").drop("restricted", "ok")
    return hits if blocked is None else hits.join(blocked, ["qid", "id"], "left_anti")
