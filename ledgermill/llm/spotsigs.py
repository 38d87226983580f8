"""SpotSigs document fingerprints: chains of content words behind common-word anchors.

Each occurrence of an anchor (a common function word) opens a chain of the next
``CHAIN`` content words, anchors in between left out; anchor and chain together are
one spot signature.  The start of a text counts as an anchor too, so every text with a
content word has a signature; a text of anchors alone is signed as a whole.  The
fingerprint is the set of signatures.

Near duplicates are found in partitions of set length, so only sets whose sizes allow
the threshold meet: each set is filed under the rarest signatures of its prefix, and a
pair that shares one is compared only while its size bound still allows the threshold
(pruned Jaccard).

Scaling: only DataFrame expressions, within whole rows.  The next document in order of
id is found from narrow rows in range partitions.  Texts are shuffled once; the next
document sends the few characters and the fingerprint that are needed, no more.
Equal fingerprints are collapsed before pairs are formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.llm.shared import stored

CHAIN = 2
#: Ids of one range partition in which their order is found, and the least number of partitions.
RANGE_ROWS = 500_000
RANGES = 128

#: Common words of four languages that anchor the chains; fixed values.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "auf das dem den der des die ein eine einen einer ich im in ist mit nicht sie und von zu "
    "au aux ce dans de des du elle en est et il la le les ne par pas pour que qui sur un une "
    "al como con del el en es la las lo los más no para por que se su un una y"
).split()
_SET = sorted(set(ANCHORS))


def signatures(text: Column) -> Column:
    """Sorted array of the distinct spot signatures (32-bit) of a text; null and blank texts have none."""
    found = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    parts = F.transform(F.array(found), lambda w: F.struct(w.alias("w"), F.filter(F.sequence(F.lit(0), F.size(w)), lambda i: F.get(w, i).isin(_SET)).alias("at"), F.filter(w, lambda x: ~x.isin(_SET)).alias("content")))

    def signed(p: Column) -> Column:
        spots = F.transform(p["at"], lambda i, j: F.when(F.get(p["content"], i - j).isNotNull(), F.hash(F.get(p["w"], i), *[F.get(p["content"], i - j + c) for c in range(CHAIN)])))
        start = F.when(F.size(p["content"]) > 0, F.hash(F.lit("^"), *[F.get(p["content"], F.lit(c)) for c in range(CHAIN)])).when(F.size(p["w"]) > 0, F.hash(F.lit("^"), F.array_join(p["w"], " ")))
        return F.array_sort(F.array_distinct(F.array_compact(F.concat(spots, F.array(start)))))

    return F.get(F.transform(parts, signed), F.lit(0))


def as_text(signed: Column) -> Column:
    """The fingerprint as a string: its signatures in hexadecimal, in order."""
    return F.array_join(F.transform(signed, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints; two empty ones are alike, an empty and another are not.

    Pruned: without a common signature (found at the first) no sizes are needed.
    """
    common = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when(~F.arrays_overlap(a, b), F.lit(0.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def neighbours(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, next_id, prev_id, prev_chars, mark): the order of the distinct ids, cyclic.

    ``mark`` is the hash of the text that stands for an id given more than once.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("chars"))
    rows = narrow.groupBy("id").agg(F.min(F.struct("mark", "chars")).alias("one")).select("id", "one.mark", "one.chars")
    ranges = max(RANGES, -(-docs.count() // RANGE_ROWS))
    ranged = stored(rows.repartitionByRange(ranges, F.col("id").asc_nulls_first()).withColumn("part", F.spark_partition_id()), "spot-order")
    within = Window.partitionBy("part").orderBy(F.col("id").asc_nulls_first())
    me = F.struct("id", "chars")
    linked = ranged.withColumns({"before": F.lag(me).over(within), "after": F.lead(me).over(within)})
    # one row per range partition
    ends = ranged.groupBy("part").agg(F.min_by(me, F.struct(F.col("id").isNotNull(), "id")).alias("low"), F.max_by(me, F.struct(F.col("id").isNotNull(), "id")).alias("high"))
    ring = Window.orderBy("part")
    around = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("high").over(ring), F.last("high").over(around)).alias("ring_before"), F.coalesce(F.lead("low").over(ring), F.first("low").over(around)).alias("ring_after"))
    linked = linked.join(F.broadcast(ends), "part")  # one row per range
    before, after = F.coalesce("before", "ring_before"), F.coalesce("after", "ring_after")
    return stored(linked.select("id", "mark", after["id"].alias("next_id"), before["id"].alias("prev_id"), before["chars"].alias("prev_chars")), "spot-neighbours")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness.

    The edited text is the text with its last floor(n / 4) code points replaced by the
    first as many (or all) of the next document in order of id; the first follows the last.
    Returns id, n_chars, edited, signatures, edited_signatures, near_edited, near_next.

    Edge cases: a null text counts as empty; a null id comes before all others; rows
    that repeat an id share their neighbours, and the one with the smallest text hash
    stands for them as a neighbour; a single document is its own next one; further
    columns are ignored; an empty table gives an empty result.
    """
    order = neighbours(docs, id_col, text_col)
    # an id is a key of the shuffle, so null has to be a value
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    given = docs.select(key(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = order.withColumns({"key": key("id"), "prev_key": key("prev_id")})
    # the narrow side is hashed and both uses read the same columns, so that the texts are dealt out once
    rows = given.join(order.hint("shuffle_hash"), "key").withColumn("signatures", signatures(F.col("text")))
    stands = F.xxhash64("text") == F.col("mark")
    sent = (
        rows.select(F.col("prev_key").alias("to"), F.when(stands, F.expr("substring(text, 1, prev_chars div 4)")).alias("head"), F.when(stands, F.col("signatures")).alias("next_signatures"))
        .groupBy("to")
        .agg(F.first("head", ignorenulls=True).alias("head"), F.first("next_signatures", ignorenulls=True).alias("next_signatures"))
    )
    chars = F.length("text")
    # repeated ids may differ in length from the text that stands for them
    edited = F.concat(F.expr("substring(text, 1, length(text) - length(text) div 4)"), F.expr("substring(head, 1, length(text) div 4)"))
    joined = rows.join(sent.hint("shuffle_hash"), F.col("key") == F.col("to"), "left").withColumn("edited", edited).withColumn("edited_signatures", signatures(F.col("edited")))
    return joined.select(
        F.col("id").alias(id_col),
        chars.cast("long").alias("n_chars"),
        "edited",
        "signatures",
        "edited_signatures",
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
    )


def near_pairs(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, likeness) of all pairs of distinct fingerprints with likeness of at least ``threshold``.

    a < b are the smallest ids of their fingerprints; membership follows from equal
    fingerprints.  Empty fingerprints pair with nothing, null ids stand for nothing.

    Of sets of size n only the n - ceil(threshold * n) + 1 rarest signatures can be the
    first that a pair shares; lengths fall into partitions that grow by 1 / threshold, and a
    set meets only its own partition and the next one.
    """
    signed = docs.select(F.col(id_col).alias("id"), signatures(F.col(text_col)).alias("sigs")).where("size(sigs) > 0 and id is not null")
    sets = stored(signed.groupBy("sigs").agg(F.min("id").alias("id")), "spot-sets")
    counts = sets.select("id", F.explode("sigs").alias("sig"))
    rare = counts.join(counts.groupBy("sig").agg(F.count(F.lit(1)).alias("n")), "sig").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "sig"))).alias("ranked"))
    prefix = F.expr(f"slice(ranked, 1, cast(size(ranked) - ceil({threshold}D * size(ranked)) + 1 as int))")
    part = F.floor(F.log(F.size("sigs").cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9).cast("int")
    filed = stored(sets.join(rare, "id").select("id", "sigs", prefix.alias("prefix"), part.alias("part")), "spot-filed")
    keys = filed.select("id", "part", F.size("sigs").alias("size"), F.explode("prefix.sig").alias("sig"))
    right = keys.select(F.col("id").alias("id2"), F.col("part").alias("part2"), F.col("size").alias("size2"), "sig")
    both = keys.withColumn("part2", F.explode(F.array(F.col("part"), F.col("part") + 1))).join(right, ["sig", "part2"])
    # the size bound of the Jaccard similarity; within one partition each pair once
    bound = (F.least("size", "size2") >= F.lit(threshold) * F.greatest("size", "size2")) & ((F.col("part2") > F.col("part")) | (F.col("id") < F.col("id2")))
    pairs = both.where(bound).select("id", "id2").distinct()
    a, b = filed.select("id", F.col("sigs").alias("x")), filed.select(F.col("id").alias("id2"), F.col("sigs").alias("y"))
    return pairs.join(a, "id").join(b, "id2").withColumn("likeness", likeness(F.col("x"), F.col("y"))).where(F.col("likeness") >= threshold).select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"), "likeness")
