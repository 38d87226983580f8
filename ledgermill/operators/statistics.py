"""Progress, feedback, histograms, calibration and ranking quality as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.sources.store import stored

#: Rows of a total order that one task sorts.
RANGE_ROWS = 1_000_000

DECISIONS = ("auto_accepted", "user_selected", "manual_search_selected", "no_match", "auto_rejected", "exact_match")


def count_of(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def progress(rows: DataFrame, status: str, names: dict[str, Column]) -> DataFrame:
    """One row: the total and one count per name."""
    return rows.agg(F.count(F.lit(1)).alias("total"), *[count_of(c).alias(n) for n, c in names.items()])


def histogram(scores: DataFrame, score: str = "score", edges: tuple[float, ...] = (0.0, 0.1, 0.2, 0.5, 1.0)) -> DataFrame:
    """(bin, count): right-closed bins, the lowest edge included, empty bins kept."""
    s = F.col(score)
    which = F.coalesce(*[F.when((s >= lo if i == 0 else s > lo) & (s <= hi), F.lit(i)) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))])
    bins = scores.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    counted = scores.select(which.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return bins.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("count"))


def _ranged(rows: DataFrame, order: list[Column], per_range: int) -> DataFrame:
    """``rows`` with ``__range``, ascending in ``order``: ranges of about ``per_range`` rows.

    Rows of several ranges are dealt by range once and stored, so that the sums and the
    places within a range are taken of the same ranges.  Nulls and frequent values are
    dealt by the later columns of ``order``.
    """
    parts = -(-rows.count() // per_range)
    if parts < 2:
        return rows.withColumn("__range", F.lit(0))
    return stored(rows.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), "ranges")


def running_sum(rows: DataFrame, value: str, weight: Column, name: str, ties: tuple[str, ...] = (), per_range: int = RANGE_ROWS, apart: bool = False) -> DataFrame:
    """``rows`` with ``name``: the sum of ``weight`` up to and with the row, in order of ``value``, nulls last, then ``ties``.

    Each range of about ``per_range`` rows is summed by a task of its own, and what
    lies in lower ranges is added, so no task orders the whole table.  Rows that are
    equal in ``value`` and ``ties`` share their sum unless they are taken ``apart``.
    """
    order = [F.asc_nulls_last(value), *[F.asc_nulls_first(t) for t in ties]]
    ranged = _ranged(rows.withColumn("__weight", weight), order, per_range)
    sums = ranged.groupBy("__range").agg(F.sum("__weight").alias("__held"))
    lower = F.coalesce(F.sum("__held").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    window = Window.partitionBy("__range").orderBy(*order)
    within = F.sum("__weight").over(window.rowsBetween(Window.unboundedPreceding, 0) if apart else window)
    below = F.broadcast(sums.select("__range", lower.alias("__below")))  # one row per range
    return ranged.withColumn("__within", within).join(below, "__range").withColumn(name, F.col("__within") + F.col("__below")).drop("__range", "__weight", "__within", "__below")


def numbered(rows: DataFrame, value: str, ties: tuple[str, ...], name: str = "place", per_range: int = RANGE_ROWS) -> DataFrame:
    """``rows`` numbered from 1 in order of ``value``, nulls last, then ``ties``; rows equal in all of them in any order."""
    return running_sum(rows, value, F.lit(1).cast("long"), name, ties, per_range, apart=True)


def nearest_rank(values: DataFrame, column: str, percents: list[int]) -> DataFrame:
    """One row of percentiles: the value at index round(p / 100 * (n - 1)), half to even, of the sorted values.

    Equal values are combined first, and only their running counts are ordered, in ranges.
    """
    counted = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    running = running_sum(counted, "v", F.col("n"), "upto")
    total = counted.agg(F.sum("n").alias("total"))
    picks = [F.min(F.when(F.col("upto") > F.bround(F.lit(p / 100.0) * (F.col("total") - 1)), F.col("v"))).alias(f"p{p}") for p in percents]
    return running.crossJoin(F.broadcast(total)).agg(*picks)  # a single row of totals


def roc_auc(rows: DataFrame, label: str, score: str, per_range: int = RANGE_ROWS) -> DataFrame:
    """One row (auc, positives, negatives): the rank-sum form, ties at mid rank; null with one class only.

    Equal scores are combined first; the running count is over distinct scores, in ranges.
    """
    g = rows.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    g = running_sum(g, "s", F.col("n"), "upto", per_range=per_range).withColumn("mid", F.col("upto") - (F.col("n") - 1) / 2.0)
    p, n = F.sum("pos"), F.sum("n") - F.sum("pos")
    return g.agg(F.round((F.sum(F.col("pos") * F.col("mid")) - p * (p + 1) / 2.0) / F.nullif(p * n, F.lit(0)), 6).alias("auc"), p.alias("positives"), n.alias("negatives"))


def calibration(scored: DataFrame, sample: DataFrame) -> DataFrame:
    """One row (accuracy, true_mean, true_p10, sample_mean, sample_p90, gap) of first candidates.

    ``scored``: (qid, id, score, truth) of requests whose answer is known, null id without
    a candidate; ``sample``: (score) of requests without one.
    """
    hit = F.coalesce(F.col("id") == F.col("truth"), F.lit(False)).cast("int")
    right = scored.agg(F.avg(hit).alias("accuracy"), F.avg("score").alias("true_mean"))
    other = sample.agg(F.avg("score").alias("sample_mean"))
    low, high = nearest_rank(scored, "score", [10]), nearest_rank(sample, "score", [90])
    row = right.crossJoin(low).crossJoin(other).crossJoin(high)  # single rows
    return row.select("accuracy", "true_mean", F.col("p10").alias("true_p10"), "sample_mean", F.col("p90").alias("sample_p90"), (F.col("p10") - F.col("p90")).alias("gap"))


def ground_truth(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """(qid, truth): the first catalog row (by id) that is no group header and has the request's normalised name.

    ``requests``: (qid, name); ``catalog``: (id, name, header); empty names match nothing.
    """
    firsts = catalog.where(~F.col("header") & (F.col("name") != "")).groupBy("name").agg(F.min("id").alias("truth"))
    return requests.where("name <> ''").join(firsts, "name").select("qid", "truth")


def feedback_counts(feedback: DataFrame, by: str, column: str = "decision") -> DataFrame:
    """Per ``by`` one count for each of the six decision types, and the total, which counts unknown types too."""
    return feedback.groupBy(by).agg(*[count_of(F.col(column) == d).alias(d) for d in DECISIONS], F.count(F.lit(1)).alias("total"))


def auto_match_stats(decided: DataFrame) -> DataFrame:
    """One row of counts of a batch's decisions as ``fusion.decide`` makes them."""
    exact, accepted, rejected = (count_of(F.col("decision") == d) for d in ("exact_match", "auto_accepted", "auto_rejected"))
    n = F.count(F.lit(1))
    return decided.agg(
        n.alias("checked"), (exact + accepted).alias("auto_matched"), exact.alias("exact_matches"), accepted.alias("threshold_matches"), rejected.alias("auto_rejected"), (n - exact - accepted - rejected).alias("still_pending")
    )


def product_counts(products: DataFrame, by: str = "upload_id") -> DataFrame:
    """Per upload: rows that are active and no group header, and the next free source_row."""
    live = F.coalesce(F.col("active"), F.lit(True)) & ~F.col("header")
    return products.groupBy(by).agg(count_of(live).alias("product_count"), (F.coalesce(F.max("source_row"), F.lit(0)) + 1).alias("next_source_row"))


def source_counts(sources: DataFrame, versions: DataFrame, products: DataFrame) -> DataFrame:
    """(source_id, version_id, products): active products of each source's current version, 0 without any; archived sources hidden."""
    held = products.where(F.coalesce("active", F.lit(True))).groupBy("version_id").agg(F.count(F.lit(1)).alias("products"))
    now = versions.where("is_current").select("source_id", "version_id")
    shown = sources.where(~F.coalesce("archived", F.lit(False))).select("source_id")
    return shown.join(now, "source_id", "left").join(held, "version_id", "left").select("source_id", "version_id", F.coalesce("products", F.lit(0)).alias("products"))


def match_summary(matches: DataFrame) -> DataFrame:
    """(metric, value) of blended matches (qid, match_type, null for a request without any): requests are counted once, types by row."""
    found = F.col("match_type").isNotNull()
    one = matches.agg(
        F.countDistinct("qid").alias("total_needs"),
        F.countDistinct(F.when(found, F.col("qid"))).alias("matched"),
        count_of(F.col("match_type") == "exact-like").alias("matches_with_high_score"),
        count_of(F.col("match_type") == "related").alias("matches_with_med_score"),
    ).withColumn("missing", F.col("total_needs") - F.col("matched"))
    names = ("total_needs", "matched", "missing", "matches_with_high_score", "matches_with_med_score")
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("m")).select("m.metric", "m.value")


def status_summary(results: DataFrame, by: str, status: str = "status", kinds: tuple[str, ...] = ("found", "missing", "unclear")) -> DataFrame:
    """Per ``by``: one count for each kind, and the total."""
    return results.groupBy(by).agg(*[count_of(F.col(status) == k).alias(k) for k in kinds], F.count(F.lit(1)).alias("total"))


def act_totals(lines: DataFrame, by: str) -> DataFrame:
    """Per act: the sum of quantity times price; lines without either add nothing."""
    return lines.groupBy(by).agg(F.sum(F.coalesce(F.col("qty") * F.col("price"), F.lit(0))).alias("total"))


def training_readiness(labels: DataFrame, label: str, needed: int = 500) -> DataFrame:
    """One row: pairs, positives, negatives, how many are still needed, and whether training may start."""
    n, pos = F.count(F.lit(1)), count_of(F.col(label) == 1)
    return labels.agg(n.alias("total"), pos.alias("positives"), count_of(F.col(label) == 0).alias("negatives"), F.greatest(F.lit(needed) - n, F.lit(0)).alias("needed"), (n >= needed).alias("ready"))


def stale(runs: DataFrame, now: Column, idle_minutes: int = 10, most_hours: int = 3) -> DataFrame:
    """``runs`` (run_id, started, last_progress, done, total) with the state a reconciliation gives them."""
    idle = F.col("last_progress") < now - F.expr(f"INTERVAL {idle_minutes} MINUTES")
    old = F.col("started") < now - F.expr(f"INTERVAL {most_hours} HOURS")
    state = F.when(F.col("done") >= F.col("total"), "done").when(old | idle, "failed").otherwise("running")
    return runs.withColumn("state", state)


def batches(rows: DataFrame, order: list[str], size: int, per_range: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with ``batch`` (from 1): ``size`` rows each in ``order``, rows without a first value last."""
    placed = numbered(rows, order[0], tuple(order[1:]), "__place", per_range)
    return placed.withColumn("batch", F.ceil(F.col("__place") / size)).drop("__place")


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """One page of a listing."""
    return rows.orderBy(*order).offset(offset).limit(limit)
