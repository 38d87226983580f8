"""Mixing sources to target weights by capped water-filling.

Each source asks for a share of the total in proportion to its weight, but no more
than ``max_epochs`` times its size.  Sources above their cap are clamped and the
excess is shared again by weight among the rest, until none is above.  A document is
then taken as many whole times as its source's epochs.  For the fractional rest the
documents stand in order of a seeded hash: they are taken from the front until the
next one would overshoot, then the later ones that still fit into the gap from where
that one stood, and so on, until the gap is below ``TOLERANCE`` of the target or no
later document fits.

Scaling: only DataFrame expressions.  Texts are read for their sizes and never
shuffled; the rounds work on a stored table of (source, hash, size).  A round sums the
sizes by source and hash bin before the shuffle, so a source with a third of all rows
costs as many rows as another, and finds the exact cut in the one bin that crosses the
gap.  Gaps shrink by large factors, so a few rounds do; a large source needs one or
two.  The driver sees scalars only.  Per-source figures are broadcast up to
``BROADCAST_SOURCES`` sources (about 10 MB); beyond that both sides are salted and
shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.llm.shared import stored, word_count

#: Bits of the hash, and of its bin.
HASH_BITS = 52
BIN_BITS = 12
#: Part of a source's target that may stay open.
TOLERANCE = 0.001
BROADCAST_SOURCES = 100_000
SALTS = 32


def water_fill(sources: DataFrame, total: int, max_epochs: float) -> DataFrame:
    """``sources`` (source, weight, source_size) with ``target`` (double) added.

    Each round sums the clamped caps and the free weights into one row, so the
    driver holds three numbers; a round without a new clamp ends it.
    """
    cap, weight = F.col("source_size") * F.lit(float(max_epochs)), F.col("weight").cast("double")
    level, clamped = 0.0, -1
    while True:
        above = (cap <= weight * F.lit(level)) if clamped >= 0 else F.lit(False)
        row = sources.agg(F.count(F.when(above, 1)).alias("n"), F.sum(F.when(above, cap)).alias("held"), F.sum(F.when(~above, weight)).alias("free")).first()
        if row["n"] == clamped or not row["free"]:
            break
        clamped, level = row["n"], max(0.0, total - (row["held"] or 0.0)) / row["free"]
    return sources.withColumn("target", F.least(cap, weight * F.lit(level)))


def _u(ids: Column, seed: int) -> Column:
    """A seeded hash of the id, uniform over 52 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), ids), 64 - HASH_BITS)


def _with_facts(rows: DataFrame, facts: DataFrame, n: int) -> DataFrame:
    """Joins the facts of each source (of) to its rows (of, u); nulls are a source too."""
    facts = facts.withColumnRenamed("of", "facts_of")
    same = F.col("of").eqNullSafe(F.col("facts_of"))
    if n <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(facts), same).drop("facts_of")
    salted = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("row_salt", F.pmod("u", F.lit(SALTS)).cast("int")).join(salted, same & (F.col("row_salt") == F.col("salt"))).drop("facts_of", "salt", "row_salt")


def _round(sized: DataFrame, gaps: DataFrame, n: int) -> DataFrame:
    """What one round takes of each source: (of, since, until, most, left, next).

    Rows with since < u <= until and size <= most are taken; they leave the gap
    ``left``, to be filled from rows after ``next``.
    """
    fit = _with_facts(sized, gaps.select("of", F.col("gap").alias("most"), "since"), n).where((F.col("u") > F.col("since")) & (F.col("size") <= F.col("most")) & (F.col("size") > 0))
    fit = fit.withColumn("bin", F.shiftright("u", HASH_BITS - BIN_BITS))
    bins = fit.groupBy("of", "most", "since", "bin").agg(F.sum("size").alias("held"))
    reached = F.sum("held").over(Window.partitionBy("of").orderBy("bin"))
    # the first bin that does not fit whole; a source without one takes all that is left
    per_bin = bins.withColumn("reached", reached).withColumn("over", F.col("reached") > F.col("most"))
    crossing = per_bin.groupBy("of", "most", "since").agg(
        F.min(F.when(F.col("over"), F.struct("bin", (F.col("reached") - F.col("held")).alias("before")))).alias("cross"), F.sum("held").alias("held")
    )
    crossing = stored(crossing.select("of", "most", "since", "held", "cross.bin", "cross.before"), "mix-crossing")
    inside = _with_facts(fit.select("of", "u", "size", F.col("bin").alias("at")), crossing.where("bin is not null").select("of", "bin", "before", "most"), n).where("at = bin")
    steps = inside.groupBy("of", "u", "before", "most").agg(F.sum("size").alias("step"))
    total = F.col("before") + F.sum("step").over(Window.partitionBy("of").orderBy("u"))
    cut = (
        steps.withColumn("total", total)
        .groupBy("of")
        .agg(F.min(F.when(F.col("total") > F.col("most"), F.col("u"))).alias("stop"), F.max(F.when(F.col("total") <= F.col("most"), F.col("total"))).alias("got"))
        .withColumnRenamed("of", "cut_of")
    )
    found = crossing.join(cut, F.col("of").eqNullSafe(F.col("cut_of")), "left")
    end = F.lit(2**HASH_BITS)
    taken = F.when(F.col("bin").isNull(), F.col("held")).otherwise(F.coalesce("got", "before"))
    return found.select("of", "since", F.coalesce(F.col("stop") - 1, end).alias("until"), "most", (F.col("most") - taken).alias("left"), F.coalesce("stop", end).alias("next"))


def mix(docs: DataFrame, weights: DataFrame | None = None, total: int | None = None, max_epochs: float = 3.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str | None = None) -> DataFrame:
    """``docs`` with the columns size, source_size, target, times and taken added.

    ``weights``: (source, weight), by default 1, 2, 3, repeating over the sources by
    code point, null last.  ``total`` (words): by default all sizes together.
    ``size_col`` holds the sizes if they are known, so that no text is read.
    ``times`` is how often the mix takes the row, ``taken`` = size * times.  The words
    taken of a source miss its target by less than ``TOLERANCE`` of it or less than the
    smallest of its documents that are not taken once more than the others.

    Edge cases: null is a source of its own; a null or empty text has size 0; a source
    without words has target 0 and is not taken; rows of equal id and size share their
    fate; columns of ``docs`` with the added names are replaced, all others stay
    whatever their names; an empty table gives an empty result.  Reruns agree, as choices
    depend on ids, sizes and the seed only.
    """
    added = ("size", "source_size", "target", "times", "taken")
    names = [c for c in docs.columns if c.lower() not in added]
    size = (F.coalesce(docs[size_col].cast("long"), F.lit(0).cast("long")) if size_col else word_count(docs[text_col])).alias("size")
    # the columns of docs by number, so that no name can clash
    rows = docs.select(*[docs[c].alias(f"c{k}") for k, c in enumerate(names)], docs[source_col].alias("of"), _u(docs[id_col], seed).alias("u"), size)
    sized = rows.select("of", "u", "size")
    sized = sized if size_col else stored(sized, "mix-sizes")
    sources = sized.groupBy("of").agg(F.sum("size").alias("source_size"))
    if weights is None:
        ranked = Window.orderBy(F.col("of").asc_nulls_last())  # one row per source
        sources = sources.withColumn("weight", (F.row_number().over(ranked) - 1) % 3 + 1)
    else:
        given = weights.select(F.col(weights.columns[0]).alias("given"), F.col(weights.columns[1]).alias("weight"))
        sources = sources.join(given, F.col("of").eqNullSafe(F.col("given"))).drop("given")
    sources = stored(sources, "mix-sources")
    facts = sources.agg(F.sum("source_size").alias("all"), F.count(F.lit(1)).alias("n")).first()
    n = facts["n"]
    filled = water_fill(sources, (facts["all"] or 0) if total is None else total, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    figures = stored(filled.withColumn("whole", whole).select("of", "source_size", "target", "whole"), "mix-figures")

    open_ = F.col("gap") > F.greatest(F.lit(TOLERANCE) * F.col("target"), F.lit(0.5))
    gaps = figures.select("of", "target", (F.col("target") - F.col("whole") * F.col("source_size")).alias("gap"), F.lit(-1).cast("long").alias("since")).where(open_)
    picks = None
    while True:  # a round takes a row or passes one by in each source, and ends with those that no row fits
        found = stored(_round(sized, gaps, n), "mix-round")
        if found.isEmpty():
            break
        pick = found.select(F.col("of"), F.struct("since", "until", "most").alias("pick"))
        picks = pick if picks is None else picks.unionByName(pick)
        left = found.select("of", F.col("left").alias("gap"), F.col("next").alias("since")).join(figures.select(F.col("of").alias("target_of"), "target"), F.col("of").eqNullSafe(F.col("target_of")))
        gaps = left.select("of", "target", "gap", "since").where(open_)
    if picks is None:
        figures = figures.withColumn("picks", F.expr("cast(array() as array<struct<since:bigint,until:bigint,most:double>>)"))
    else:
        picked = picks.groupBy("of").agg(F.collect_list("pick").alias("picks")).withColumnRenamed("of", "picks_of")
        figures = figures.join(picked, F.col("of").eqNullSafe(F.col("picks_of")), "left").drop("picks_of")
    figures = stored(figures, "mix-picks")
    once_more = F.exists("picks", lambda p: (F.col("u") > p["since"]) & (F.col("u") <= p["until"]) & (F.col("size") <= p["most"]))
    times = (F.col("whole") + F.when(F.coalesce(once_more, F.lit(False)) & (F.col("size") > 0), 1).otherwise(0)).cast("long")
    joined = _with_facts(rows, figures, n).withColumn("times", times).withColumn("taken", F.col("times") * F.col("size"))
    return joined.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], *added)


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as the mix takes it, same columns."""
    names = docs.columns
    at = {c: names.index(options.get(f"{c}_col", d)) for c, d in (("id", "doc_id"), ("text", "text"), ("source", "source"))}
    numbered = docs.toDF(*[f"c{k}" for k in range(len(names))])
    taken = mix(numbered, **options | {f"{c}_col": f"c{k}" for c, k in at.items()}).where("times > 0")
    return taken.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)])
