"""Set-similarity join: all pairs of sets with a Jaccard likeness from a threshold on.

Elements are put in one order, rare ones first.  Two sets that are alike enough share an
element among the first few of each (the prefix), have sizes not too far apart, and
leave enough elements after the shared one.  So sets meet in an equi-join on the
elements of their prefixes, under these filters and one of the elements that they have
apart by 128 bits of each set, and only the pairs that are left are compared.  An element that very many prefixes hold is dealt in parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.functions.similarity import feature_similarity, jaccard, name_features
from ledgermill.operators.retrieval import small
from ledgermill.sources.store import stored

#: Sets of one side that meet all sets of the other side in a task, about.
PART_SETS = 1_000
#: Members of a class in one list, about, and members of all classes whose lists are broadcast.
LIST_MEMBERS, BROADCAST_MEMBERS = 10_000, 10_000_000


def _signature(half: int) -> Column:
    """64 of 128 bits: which places an odd number of the set's elements falls on.

    An element that only one of two sets has changes one bit, so they differ in no more
    bits than they have elements apart.
    """
    bit = "shiftleft(1L, cast(pmod(xxhash64(e), 64) as int))"
    return F.expr(f"aggregate(set, 0L, (acc, e) -> acc ^ if(pmod(shiftright(xxhash64(e), 6), 2) = {half}, {bit}, 0L))")


def _prefixes(sets: DataFrame, frequency: DataFrame, at_least: float) -> DataFrame:
    """(id, size, s0, s1, at, element): the elements that a set must share one of, with their place from 0, and its signature."""
    one = sets.select("id", F.explode("set").alias("element")).join(frequency, "element")
    order = one.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "element"))).alias("s"))  # a set's own elements
    size = F.size("s")
    first = order.select("id", size.alias("size"), F.slice("s", F.lit(1), size - F.ceil(F.lit(at_least) * size - 1e-9).cast("int") + 1).alias("s"))
    first = first.join(sets.select("id", _signature(0).alias("s0"), _signature(1).alias("s1")), "id")
    return first.select("id", "size", "s0", "s1", F.posexplode("s").alias("at", "e")).select("id", "size", "s0", "s1", "at", F.col("e.element").alias("element"))


def similar_sets(left: DataFrame, right: DataFrame | None, at_least: float, part_sets: int = PART_SETS) -> DataFrame:
    """(left_id, right_id, score) of (id, set of distinct strings) on both sides with a Jaccard likeness of ``at_least`` (over 0) or more.

    Without ``right`` pairs of ``left`` with left_id < right_id.  Empty and null sets are
    like nothing.
    """
    if not 0 < at_least <= 1:
        raise ValueError("a likeness over 0 and up to 1")
    alone, right = right is None, left if right is None else right
    frequency = (left if alone else left.select("set").union(right.select("set"))).select(F.explode("set").alias("element")).groupBy("element").agg(F.count(F.lit(1)).alias("n"))
    a = _prefixes(left, frequency, at_least)
    b = a if alone else _prefixes(right, frequency, at_least)
    held = a.groupBy("element").agg((F.floor(F.count(F.lit(1)) / part_sets) + 1).cast("int").alias("parts")).where("parts > 1")  # few
    held = small(held, 100_000)
    x = a.join(held, "element", "left").select(F.col("id").alias("left_id"), F.col("size").alias("m"), F.col("at").alias("i"), F.col("s0").alias("a0"), F.col("s1").alias("a1"), "element", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    y = b.join(held, "element", "left").select(F.col("id").alias("right_id"), F.col("size").alias("n"), F.col("at").alias("j"), F.col("s0").alias("b0"), F.col("s1").alias("b1"), "element", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    need = F.ceil(F.lit(at_least) / (1 + at_least) * (F.col("m") + F.col("n")) - 1e-9)
    near = (F.col("n") >= at_least * F.col("m") - 1e-9) & (F.col("m") >= at_least * F.col("n") - 1e-9) & (F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j")) >= need)
    # elements that only one of the two has: (m + n) less twice the common ones
    apart = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1")))
    near = near & (apart <= F.col("m") + F.col("n") - 2 * need)
    # a fixed number of tasks: the tables are small, the work on what they make together is not
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = x.repartition(tasks, "element", "part")
    pairs = x.join(y, ["element", "part"]).where(near & (F.col("left_id") < F.col("right_id")) if alone else near).select("left_id", "right_id").repartition(tasks, "left_id", "right_id").distinct()
    both = pairs.join(left.select(F.col("id").alias("left_id"), F.col("set").alias("s")), "left_id").join(right.select(F.col("id").alias("right_id"), F.col("set").alias("t")), "right_id")
    return both.select("left_id", "right_id", jaccard(F.col("s"), F.col("t")).alias("score")).where(F.col("score") >= at_least - 1e-9)


def member_lists(rows: DataFrame, key: str, member: str) -> DataFrame:
    """(key, ``member`` + "s"): the members of each class in lists of a bounded length; broadcast if they are few in all."""
    n = rows.groupBy(key).agg((F.floor(F.count(F.lit(1)) / LIST_MEMBERS) + 1).cast("int").alias("lists"))
    large = small(n.where("lists > 1"), 100_000)
    part = F.pmod(F.xxhash64(member), F.coalesce("lists", F.lit(1)))
    lists = rows.join(large, key, "left").groupBy(key, part.alias("part")).agg(F.collect_list(member).alias(f"{member}s")).drop("part")  # of a bounded length
    return F.broadcast(lists) if rows.count() <= BROADCAST_MEMBERS else lists


def expand_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``pairs`` (left_key, right_key, ...) of classes for each pair of their members, of (left_key, qid) and (right_key, id).

    Each pair of classes may stand for very many rows.  They are made where the pair lies,
    by no shuffle and no lookup a row; what holds for all of them is worked out before.
    """
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = pairs.repartition(tasks, "left_key", "right_key").join(member_lists(left, "left_key", "qid"), "left_key").join(member_lists(right, "right_key", "id"), "right_key")
    rest = [c for c in pairs.columns if c not in ("left_key", "right_key")]
    return both.select(*rest, "ids", F.explode("qids").alias("qid")).select("qid", F.explode("ids").alias("id"), *rest)


def name_classes(names: DataFrame) -> DataFrame:
    """(id, rep, f): the features of each name (id, name) that is not blank, and the smallest id with the same cleaned name."""
    made = names.select("id", name_features("name").alias("f")).where(F.col("f.clean") != "")
    reps = made.groupBy(F.col("f.clean").alias("clean")).agg(F.min("id").alias("rep"))
    return made.withColumn("clean", F.col("f.clean")).join(reps, "clean").select("id", "rep", "f")


def similar_names(names: DataFrame, at_least: float = 0.6) -> DataFrame:
    """(qid, id, score) of all pairs qid < id of class representatives of (id, name) whose blended likeness is ``at_least`` or more.

    Names equal after cleaning are one, under their smallest id (``name_classes``); each
    of them is as like another name as any other.  The blend is 0.55 of the words' and
    0.45 of the characters' likeness, so a pair needs a likeness of the words of
    (at_least - 0.45) / 0.55, by which it is found; ``at_least`` must be above 0.45.
    """
    words = (at_least - 0.45) / 0.55
    if words <= 0:
        raise ValueError("pairs that only characters make alike are not looked for: a likeness over 0.45")
    # different names alone are cleaned, in a fixed number of tasks, and representatives alone have features made
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    different = names.select("id", "name").repartition(tasks, "name").groupBy("name").agg(F.min("id").alias("id"))
    clean = different.select("id", "name", name_features("name")["clean"].alias("clean")).where("clean <> ''")
    first = clean.groupBy("clean").agg(F.min(F.struct("id", "name")).alias("r")).select("r.id", "r.name")
    reps = stored(first.select("id", name_features("name").alias("f")), "names")
    found = similar_sets(reps.select("id", F.col("f.words").alias("set")), None, words)
    both = found.join(reps.select(F.col("id").alias("left_id"), F.col("f").alias("f")), "left_id").join(reps.select(F.col("id").alias("right_id"), F.col("f").alias("g")), "right_id")
    score: Column = F.round(feature_similarity(F.col("f"), F.col("g")), 6)
    return both.select(F.col("left_id").alias("qid"), F.col("right_id").alias("id"), score.alias("score")).where(F.col("score") >= at_least)
