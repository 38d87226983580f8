"""Review workflow and catalog mutations as batch rewrites of their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.operators.retrieval import top_k

#: Review decisions and what they are stored as; fixed values.
DECISION_TYPES = {"авто": "auto_accepted", "вручную": "user_selected", "отклонено": "no_match", "без совпадения": "no_match"}
AUTO_METHODS = {"exact_match": "exact_match", "hybrid_threshold": "auto_accepted_hybrid", "llm_confirmed": "llm_auto_matched"}


def _mapped(c: Column, values: dict[str, str], default: Column | None = None) -> Column:
    return F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in values.items()], *([default] if default is not None else []))


def decision_for_rank(rank: Column) -> Column:
    """Ranks 1 to 3 were shown and chosen; any other comes from a manual search."""
    return F.when(F.coalesce(rank.between(1, 3), F.lit(False)), "user_selected").otherwise("manual_search_selected")


def save_decisions(decisions: DataFrame, requests: DataFrame) -> DataFrame:
    """Stored form of (qid, id, decision, source, saved): matches and feedback in one row each.

    Rows already saved, skipped ones and unknown requests are left out.
    """
    known = requests.select("qid").distinct()
    kind = _mapped(F.col("decision"), DECISION_TYPES)
    fresh = decisions.join(known, "qid", "left_semi").where(~F.coalesce("saved", F.lit(False)) & (F.col("decision") != "пропущено"))
    method = F.when(F.col("decision") == "авто", _mapped(F.col("source"), AUTO_METHODS, F.lit("exact_match"))).when(F.col("decision") == "вручную", "hybrid_top3")
    return fresh.where(kind.isNotNull()).select("qid", F.when(kind != "no_match", F.col("id")).alias("id"), kind.alias("decision_type"), F.when(kind != "no_match", method).alias("method"), F.when(kind == "no_match", "no_match").otherwise("matched").alias("status"))


def select_manually(matches: DataFrame, choice: DataFrame) -> DataFrame:
    """(qid, id, rank, score, selected) after a manual choice (qid, id): others are cleared; a new one gets rank 0 and score 1."""
    chosen = choice.select("qid", F.col("id").alias("chosen"))
    kept = matches.join(chosen, "qid", "left").withColumn("selected", F.when(F.col("chosen").isNull(), F.col("selected")).otherwise(F.col("id") == F.col("chosen"))).drop("chosen")
    new = choice.join(matches, ["qid", "id"], "left_anti").select("qid", "id", F.lit(0).alias("rank"), F.lit(1.0).alias("score"), F.lit(True).alias("selected"))
    return kept.select("qid", "id", "rank", "score", "selected").unionByName(new)


def replace_version(products: DataFrame, incoming: DataFrame, matches: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """(products, matches) with the version's rows replaced and matches to the old ones dropped."""
    old = products.where(F.col("version_id") == version)
    return products.where(F.col("version_id") != version).unionByName(incoming), matches.join(old.select("id"), "id", "left_anti")


def set_current(versions: DataFrame, version: int) -> DataFrame:
    """Exactly one current version in the source of ``version``; other sources stay."""
    source = versions.where(F.col("version_id") == version).select(F.col("source_id").alias("s")).distinct()
    marked = versions.join(F.broadcast(source), F.col("source_id") == F.col("s"), "left")
    return marked.withColumn("is_current", F.when(F.col("s").isNotNull(), F.col("version_id") == version).otherwise(F.col("is_current"))).drop("s")


def reorder(fields: DataFrame, by: str = "position") -> DataFrame:
    """Positions 10, 20, ... of each source's fields."""
    return fields.withColumn("position", F.row_number().over(Window.partitionBy("source_id").orderBy(by, "field_key")) * 10)


def count_backfilled(products: DataFrame, category: Column, category_name: Column) -> DataFrame:
    """One row: how many products' category or its name a recomputation changes."""
    changed = ~(F.col("category").eqNullSafe(category) & F.col("category_name").eqNullSafe(category_name))
    return products.agg(F.count(F.when(changed, 1)).alias("changed"))


def merge_sources(candidates: DataFrame, n: int) -> DataFrame:
    """Best candidate per (qid, id) over the sources (the first source of equal scores), then the n best."""
    best = candidates.groupBy("qid", "id").agg(F.max("score").alias("score"), F.min_by("source", F.struct(-F.col("score"), "source")).alias("source"))
    return top_k(best, n)


def auto_select(ranked: DataFrame, at_least: float = 0.8) -> DataFrame:
    """Rank 1 is selected from ``at_least``; explanations name their source."""
    return ranked.withColumns({"selected": (F.col("rank") == 1) & (F.col("score") >= at_least), "note": F.concat(F.lit("["), "source", F.lit("] "), F.coalesce("note", F.lit("")))})


def inject_codes(pool: DataFrame, code_hits: DataFrame) -> DataFrame:
    """The pool and, with score 0, the code matches outside it."""
    return pool.select("qid", "id", "score").unionByName(code_hits.join(pool, ["qid", "id"], "left_anti").select("qid", "id", F.lit(0.0).alias("score")))


def category_pool(requests: DataFrame, catalog: DataFrame, rest: str = "Прочее") -> DataFrame:
    """(qid, id): catalog rows that share a class with the request; the whole catalog if it has none, as one row with a null id.

    ``requests`` and ``catalog`` carry an array ``classes``.  The null row stands for
    every catalog row, so that unrestricted requests are not multiplied.
    """
    q = requests.where(~F.array_contains("classes", rest)).select("qid", F.explode("classes").alias("c"))
    hits = catalog.select("id", F.explode("classes").alias("c")).join(q, "c").select("qid", "id").distinct()
    return hits.unionByName(requests.select("qid").join(hits.select("qid").distinct(), "qid", "left_anti").select("qid", F.lit(None).cast(dict(hits.dtypes)["id"]).alias("id")))


def nested_matches(items: DataFrame, matches: DataFrame, products: DataFrame) -> DataFrame:
    """Items with their matches as an array ordered by rank."""
    joined = matches.join(products.select("id", "name"), "id", "left")
    lists = joined.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "name", "score"))).alias("matches"))
    return items.join(lists, "qid", "left")


def join_replies(items: DataFrame, replies: DataFrame) -> DataFrame:
    """Reply rows to (qid, pos, item): by equal name in any case, else by position."""
    by_name = replies.groupBy(F.lower(F.trim("item")).alias("k")).agg(F.max_by("value", "pos").alias("named"))
    by_pos = replies.groupBy("pos").agg(F.first("value").alias("placed"))
    return items.join(by_name, F.lower("item") == F.col("k"), "left").join(by_pos, "pos", "left").select("qid", "item", F.coalesce("named", "placed").alias("value"))


def blend_attribute(rows: DataFrame, weights: tuple[float, ...] = (0.0, 0.05, 0.1, 0.15, 0.2, 0.3)) -> DataFrame:
    """Each row's (1 - w) * final + w * attr for each w, ranked per request; w = 0 keeps the given rank."""
    w = F.explode(F.array(*[F.lit(x) for x in weights])).alias("w")
    out = rows.select("*", w).withColumn("blended", F.round((1 - F.col("w")) * F.col("final") + F.col("w") * F.col("attr"), 8))
    order = Window.partitionBy("qid", "w").orderBy(F.when(F.col("w") == 0, F.col("rank")), F.desc("blended"), "rank", "id")
    return out.withColumn("new_rank", F.row_number().over(order))


def task_progress(tasks: DataFrame) -> DataFrame:
    """(project, done, total, state): a project closes with its last open task."""
    g = tasks.groupBy("project").agg(F.count(F.when(F.col("done"), 1)).alias("done"), F.count(F.lit(1)).alias("total"))
    return g.withColumn("state", F.when(F.col("done") == F.col("total"), "closed").otherwise("open"))


def presence(activity: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    """(user_id, present): active within the last minutes."""
    return activity.groupBy("user_id").agg(F.max("ts").alias("last")).withColumn("present", F.col("last") >= now - F.expr(f"INTERVAL {minutes} MINUTES"))


def latest_matches(matches: DataFrame, products: DataFrame) -> DataFrame:
    """(qid, id, name, score) of each request's newest match (created, then id); products that are gone leave no match."""
    newest = matches.groupBy("qid").agg(F.max_by(F.struct("id", "score"), F.struct("created", "id")).alias("m")).select("qid", "m.id", "m.score")
    return newest.join(products.select("id", "name"), "id").select("qid", "id", "name", "score")


def resume(decided: DataFrame, classified: DataFrame) -> DataFrame:
    """Requests already decided as they are, all others as newly classified; both (qid, id, score, decision)."""
    columns = ["qid", "id", "score", "decision"]
    return decided.select(*columns).unionByName(classified.join(decided.select("qid"), "qid", "left_anti").select(*columns))


def set_active(products: DataFrame, ids: DataFrame, active: bool) -> DataFrame:
    """Soft delete or restore of the products in ``ids`` (id); both may be repeated."""
    marked = products.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    return marked.withColumn("active", F.when(F.col("__hit"), F.lit(active)).otherwise(F.col("active"))).drop("__hit").select(*products.columns)


def patch(products: DataFrame, changes: DataFrame) -> DataFrame:
    """Fields that ``changes`` (id, fields map<string,string>) names are set; a new name or description derives the normalised name anew.

    Of several changes of a product all count, the largest value of a field set twice.
    """
    from ledgermill.functions.text import normalized_name

    fields = [c for c in products.columns if c not in ("id", "normalized_name")]
    entries = changes.select("id", F.explode("fields").alias("field", "value"))
    set_ = entries.groupBy("id").agg(*[F.max(F.when(F.col("field") == f, F.struct("value"))).alias(f"__{f}") for f in fields])
    joined = products.join(set_, "id", "left")
    kinds = dict(products.dtypes)
    out = joined.withColumns({f: F.when(F.col(f"__{f}").isNotNull(), F.col(f"__{f}.value").try_cast(kinds[f])).otherwise(F.col(f)) for f in fields})
    renamed = F.coalesce(*[F.col(f"__{f}") for f in ("name", "description") if f in fields]).isNotNull()
    if "normalized_name" in products.columns:
        out = out.withColumn("normalized_name", F.when(renamed, normalized_name("name")).otherwise(F.col("normalized_name")))
    return out.select(*products.columns)


def detach_project(uploads: DataFrame, project_id: int) -> DataFrame:
    """The uploads of a deleted project stay without one."""
    mine = F.coalesce(F.col("project_id") == project_id, F.lit(False))
    return uploads.withColumn("project_id", F.when(~mine, F.col("project_id")))


def filter_uploads(uploads: DataFrame, upload_type: str | None = None, project_id: int | str | None = None) -> DataFrame:
    """By type and by project; the project ``none`` stands for uploads without one."""
    out = uploads if upload_type is None else uploads.where(F.col("upload_type") == upload_type)
    if project_id is None:
        return out
    return out.where(F.col("project_id").isNull()) if project_id == "none" else out.where(F.col("project_id") == project_id)


def usable_sources(sources: DataFrame) -> DataFrame:
    """Enabled (or unmarked) sources that are not archived."""
    return sources.where(F.coalesce("enabled", F.lit(True)) & ~F.coalesce("archived", F.lit(False)))


def resolve_sources(sources: DataFrame, links: DataFrame, ids: list | None = None, names: list[str] | None = None, project_id: int | None = None, name: str | None = None) -> DataFrame:
    """(source_id, name, place) of the usable sources of a run: by ids, else names, else the project's links in their order, else one name."""
    place = F.lit(None).cast("long")
    if ids:
        found = sources.where(F.col("source_id").isin(ids))
    elif names:
        found = sources.where(F.col("name").isin(names))
    elif project_id is not None:
        mine = links.where((F.col("project_id") == project_id) & F.coalesce("included", F.lit(False))).groupBy("source_id").agg(F.min("sort_order").alias("__order"))
        found, place = sources.join(mine, "source_id"), F.col("__order").cast("long")
    else:
        one = sources.where(F.col("name") == name).agg(F.min("source_id").alias("source_id"))
        found = sources.join(one, "source_id", "left_semi")
    return usable_sources(found).select("source_id", "name", place.alias("place"))


def add_field(fields: DataFrame, source_id, label: str, position: int = 0) -> DataFrame:
    """``fields`` (source_id, field_key, position, core) with one more, its key made of the label; a key that is there is an error."""
    key = label.strip().lower().replace(" ", "_")
    if not fields.where((F.col("source_id") == source_id) & (F.col("field_key") == key)).isEmpty():
        raise ValueError(f"field {key} exists")
    new = fields.sparkSession.range(1).select(F.lit(source_id).alias("source_id"), F.lit(key).alias("field_key"), F.lit(position).alias("position"), F.lit(False).alias("core"))
    return fields.unionByName(new.select(*[F.col(c).cast(t).alias(c) for c, t in fields.select("source_id", "field_key", "position", "core").dtypes]), allowMissingColumns=True)


def drop_fields(fields: DataFrame, gone: DataFrame) -> DataFrame:
    """``fields`` without those in ``gone`` (source_id, field_key); core fields stay."""
    marked = fields.join(gone.select("source_id", "field_key").distinct().withColumn("__gone", F.lit(True)), ["source_id", "field_key"], "left")
    return marked.where(F.col("core") | F.col("__gone").isNull()).select(*fields.columns)


def replace_mappings(mappings: DataFrame, source_id: int, new: DataFrame) -> DataFrame:
    """Import mappings (source_id, excel_header, field_key) with those of one source replaced; blank headers are skipped."""
    made = new.select(F.lit(source_id).cast(dict(mappings.dtypes)["source_id"]).alias("source_id"), F.lower(F.trim("excel_header")).alias("excel_header"), F.trim("field_key").alias("field_key"))
    return mappings.where(F.col("source_id") != source_id).unionByName(made.where("excel_header <> ''"))


def add_product(products: DataFrame, uploads: DataFrame, new: DataFrame) -> DataFrame:
    """``products`` and the hand-made rows ``new`` (name, price), attached to the newest active upload behind its last row.

    ``products``: (upload_id, source_row, name, normalized_name, price, active, header);
    ``uploads``: (upload_id, created, active).  Without an active upload nothing is added.
    """
    from ledgermill.functions.text import normalized_name

    last = products.groupBy("upload_id").agg(F.max("source_row").alias("__last"))
    target = uploads.where("active").agg(F.max_by("upload_id", F.struct("created", "upload_id")).alias("upload_id")).where("upload_id is not null").join(last, "upload_id", "left")
    rows = new.crossJoin(F.broadcast(target))  # one row
    place = F.row_number().over(Window.partitionBy("upload_id").orderBy("name", "price"))
    made = rows.select("upload_id", (F.coalesce("__last", F.lit(0)) + place).alias("source_row"), "name", normalized_name("name").alias("normalized_name"), "price", F.lit(True).alias("active"), F.lit(False).alias("header"))
    return products.unionByName(made.select(*[F.col(c).cast(t) for c, t in products.dtypes]))


def chosen_candidates(feedback: DataFrame, products: DataFrame) -> DataFrame:
    """(qid, id, name) of confirmed feedback (qid, selected) whose product is still there."""
    return feedback.where("selected is not null").select("qid", F.col("selected").alias("id")).join(products.select("id", "name"), "id").select("qid", "id", "name")


def supplier_key(name: Column) -> Column:
    """Which of the demonstration lists an item belongs to; fixed words."""
    n = F.lower(F.coalesce(name, F.lit("")))
    words = {"парт": "student desks", "стул": "classroom chairs", "доск": "interactive whiteboards", "камер": "document cameras", "шкаф": "charging cabinets"}
    return F.coalesce(*[F.when(F.contains(n, F.lit(w)), F.lit(k)) for w, k in words.items()], F.lit("default"))


def best_suppliers(suppliers: DataFrame, most: int = 2) -> DataFrame:
    """The first ``most`` suppliers (item, pos, name, best) of each item; without a best one the first is it."""
    first = top_k(suppliers.withColumn("__back", -F.col("pos")), most, "__back", "item", "pos", "__n").drop("__back", "__n")
    own = Window.partitionBy("item")
    return first.withColumn("best", F.coalesce("best", F.lit(False)) | (~F.max(F.coalesce("best", F.lit(False))).over(own) & (F.col("pos") == F.min("pos").over(own))))
