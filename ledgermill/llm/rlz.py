"""Duplicate passages by relative Lempel-Ziv parsing against an index of the corpus.

Every document is a reference block for the documents of larger id.  A document is
parsed greedily from left to right: at each word the index is asked for earlier blocks
that hold the next ``window`` words, and names two of them, the first and the nearest
one.  Of these the factor takes the one that goes on alike for longer, and follows it
as long as the index has it for the next word too; at its end - the factor boundary -
the index is asked again, so that a factor may start inside the last one and no window
that straddles a boundary is missed.  Words in no factor are literals.  Factors have at
least ``window`` words, and their words are the duplicate spans.

The index is asked for all positions at once, in two shuffles of narrow rows:
(1) anchors: the smallest ``GRAM``-word fingerprint of each window.  Equal windows have
    equal anchors, so only anchors found in two different documents matter.
(2) windows whose anchor is such a one, by 96 bits of two independent fingerprints: the
    first of them in order of id is a reference of the rest, each is one of the next.

Scaling: documents with equal word sequences are settled first, by one narrow row
each, and only the first of them is indexed.  About two positions in seven are
anchors, and only windows of shared passages go on, each once per document.  A passage
that a third of all documents share is settled where it is read: of the documents read
together all but the first (and, of anchors, the last) are certain to have an earlier
one, and their rows are dealt out by a salt.  Groups of equal anchors or windows are
never held: a running first value, the row before and the row after decide, over sorted
rows.  Texts are dealt by id once, in one exchange that all three passes reuse; what
comes back to them are positions, not fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.llm import words
from ledgermill.llm.shared import stored

WINDOW = 13
#: Words of an anchor; passages that share so many are rare unless they are copies.
GRAM = 7
#: Form of the second fingerprint.
CHECK = 32
#: Ids lie above it; what meets in the index has its second fingerprint below it in place of an id.
LEAST_ID = -(2**62)
#: There are at most so many word sequences that each have this part of all rows or more.
HOT_SHARE = 1000
#: Stands for a null id: after all others, and no reference for another null id.
NO_ID = 2**63 - 1


def _documents(batch: pa.RecordBatch, text_at: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, word fingerprints, ends of the documents in them) for ranges of rows."""
    raw, offsets = words.text_column(batch.column(text_at))
    for lo, hi in words.slices(offsets):
        found, counts = words.hash_words(raw, offsets[lo:hi], offsets[lo + 1 : hi + 1])
        yield lo, hi, found, np.cumsum(counts)


def _starts(ends: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], ends[:-1]]).astype(np.int64)


def _positions(ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, document) of each window of ``size`` words that lies in one document."""
    counts = np.maximum(ends - _starts(ends) - size + 1, 0)
    owner = np.repeat(np.arange(len(ends)), counts)
    within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return _starts(ends)[owner] + within, owner


def _anchors(found: np.ndarray, window: int) -> np.ndarray:
    """The anchor of the window at each position: its smallest gram fingerprint."""
    grams = words.windows(found, GRAM)
    n = len(found) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    least = grams[:n].copy()
    for j in range(1, window - GRAM + 1):
        np.minimum(least, grams[j : j + n], out=least)
    return least


def _sequence(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n_words, sequence): a 128-bit key of the word sequence."""
    for batch in batches:
        for lo, hi, found, ends in _documents(batch, 1):
            keys = [xxhash.xxh3_128_digest(found[s:e].tobytes()) for s, e in zip(_starts(ends).tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(ends - _starts(ends), pa.int64()), pa.array(keys, pa.binary())], names=["id", "n_words", "sequence"])


def _salt(ids: np.ndarray) -> np.ndarray:
    """A positive number that deals rows out which need no meeting."""
    return (words.mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(40)).astype(np.int32) + 1


def _emit_anchors(window: int):
    """(anchor, salt, id), each pair of anchor and id once per range of rows.

    An anchor with two ids in the range is shared for certain: its smallest and largest
    id go on to meet those of other ranges (salt 0), the others are dealt out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, found, ends in _documents(batch, 1):
                at, owner = _positions(ends, window)
                anchors, own = _anchors(found, window)[at], ids[lo + owner]
                order = np.lexsort((own, anchors))
                anchors, own = anchors[order], own[order]
                first = np.ones(len(own), bool)
                first[1:] = anchors[1:] != anchors[:-1]
                new = first.copy()
                new[1:] |= own[1:] != own[:-1]
                anchors, own, first = anchors[new], own[new], first[new]
                last = np.append(first[1:], True)
                salt = np.where(first | last, 0, _salt(own)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(salt), pa.array(own)], names=["anchor", "salt", "id"])

    return run


def _listed(batch: pa.RecordBatch, column: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, row) of a list column in rows lo to hi."""
    part = batch.column(column).slice(lo, hi - lo).fill_null([])
    sizes = np.asarray(pa.compute.list_value_length(part), np.int64)
    return np.asarray(part.flatten()), np.repeat(np.arange(hi - lo), sizes)


def _member(values: np.ndarray, owner: np.ndarray, listed: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Index in ``listed`` of an equal value of the same row, or -1."""
    if not len(listed) or not len(values):
        return np.full(len(values), -1)
    # row number and value in one 64-bit key; the value itself is compared after
    mine, theirs = words.mix(values ^ words.mix(owner.astype(np.uint64))), words.mix(listed ^ words.mix(of.astype(np.uint64)))
    order = np.argsort(theirs)
    place = np.minimum(np.searchsorted(theirs[order], mine), len(order) - 1)
    hit = order[place]
    return np.where((theirs[hit] == mine) & (listed[hit] == values) & (of[hit] == owner), hit, -1)


def _mark(found: np.ndarray, shared: bool) -> int:
    """What a position is raised by, to tell texts apart that share an id; 0 for all others."""
    return (xxhash.xxh3_64_intdigest(found.tobytes()) >> 33) << 32 if shared else 0


def _marks(found: np.ndarray, ends: np.ndarray, shared: list[bool]) -> np.ndarray:
    return np.array([_mark(found[s:e], x) for s, e, x in zip(_starts(ends).tolist(), ends.tolist(), shared)], np.int64)


def _emit_windows(window: int):
    """(print, other, id, pos, ref_at) of the windows whose anchor was asked for, once per document.

    A window that an earlier document of the same range of rows has too is settled by
    it (``other``, and the own id in place of the fingerprint); only the first one of the
    range goes on to meet those of others, with its second fingerprint as ``other``.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, shared = batch.column(0).to_numpy(zero_copy_only=False), batch.column(3).to_pylist()
            for lo, hi, found, ends in _documents(batch, 1):
                at, owner = _positions(ends, window)
                listed, of = _listed(batch, 2, lo, hi)
                asked = _member(_anchors(found, window)[at], owner, listed.astype(np.int64).view(np.uint64), of) >= 0
                at, owner = at[asked], owner[asked]
                prints, checks = words.windows(found, window)[at], (words.windows(found, window, CHECK)[at] >> np.uint64(32)).astype(np.int64)
                own, pos = ids[lo + owner], at - _starts(ends)[owner] + _marks(found, ends, shared[lo:hi])[owner]
                order = np.lexsort((pos, own, checks, prints))
                prints, checks, own, pos = prints[order], checks[order], own[order], pos[order]
                first = np.ones(len(own), bool)
                first[1:] = (prints[1:] != prints[:-1]) | (checks[1:] != checks[:-1])
                # texts that share an id are told apart by the upper half of their positions
                once = first.copy()
                once[1:] |= (own[1:] != own[:-1]) | (pos[1:] >> 32 != pos[:-1] >> 32)
                prints, checks, own, pos, first = prints[once], checks[once], own[once], pos[once], first[once]
                leader = np.flatnonzero(first)[np.cumsum(first) - 1] if len(own) else np.zeros(0, np.int64)
                settled = own[leader] < own
                other = np.where(settled, own[leader], LEAST_ID - checks)
                columns = [np.where(settled, own, prints.view(np.int64)), other, own, pos, np.where(settled, pos[leader] & 0xFFFFFFFF, 0).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["print", "other", "id", "pos", "ref_at"])

    return run


SPANS = "array<struct<start:int,length:int,ref_id:bigint,ref_start:int>>"


def factors(hits: list[int], refs: list[tuple[tuple[int, int], tuple[int, int]]], window: int) -> list[dict]:
    """Greedy factors from the positions that have references, in order.

    ``refs``: two (document, position) of each hit.  A reference goes on if the next
    position is a hit and has the place behind it as one of its references.
    """
    reach = [[1, 1] for _ in hits]  # positions for which a factor can follow each reference
    for k in range(len(hits) - 2, -1, -1):
        if hits[k + 1] == hits[k] + 1:
            for c, (doc, at) in enumerate(refs[k]):
                reach[k][c] += max((r for r, place in zip(reach[k + 1], refs[k + 1]) if place == (doc, at + 1)), default=0)
    out, k = [], 0
    while k < len(hits):
        best = int(reach[k][1] > reach[k][0])
        n, (doc, at) = reach[k][best], refs[k][best]
        out.append({"start": hits[k], "length": n + window - 1, "ref_id": doc, "ref_start": at})
        k += n
    return out


def _parse(window: int):
    span = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref_id", pa.int64()), ("ref_start", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, shared = batch.column(2).to_pylist(), batch.column(3).to_pylist()  # the first document of the same words, if not this one
            for lo, hi, found, ends in _documents(batch, 1):
                at, owner = _positions(ends, window)
                first = _starts(ends)
                places, of = _listed(batch, 4, lo, hi)
                ref_ids, ref_at, near_ids, near_at = (_listed(batch, c, lo, hi)[0] for c in range(5, 9))
                hit = np.full(len(at), -1)
                if len(places):
                    places = places - _marks(found, ends, shared[lo:hi])[of]  # of another text with this id: out of range
                    mine = np.flatnonzero((places >= 0) & (places < (ends - first)[of]))
                    hit[np.searchsorted(at, first[of[mine]] + places[mine])] = mine
                    # further places of the same window in the same document
                    some = np.flatnonzero(np.isin(owner, of))
                    _, head, same = np.unique(words.mix(words.windows(found, window)[at[some]] ^ words.mix(owner[some].astype(np.uint64))), return_index=True, return_inverse=True)
                    hit[some] = hit[some][head[same]]
                kept_rows = np.flatnonzero(hit >= 0)
                cuts = np.searchsorted(owner[kept_rows], np.arange(len(ends) + 1))
                texts, spans, removed = [], [], []
                for r, text in enumerate(batch.column(1).slice(lo, hi - lo).to_pylist()):
                    w = (text or "").encode().split()
                    if whole[lo + r] is not None and len(w) >= window:
                        parsed = [{"start": 0, "length": len(w), "ref_id": whole[lo + r], "ref_start": 0}]
                    else:
                        rows = kept_rows[cuts[r] : cuts[r + 1]]
                        mine = hit[rows]
                        refs = zip(zip(ref_ids[mine].tolist(), ref_at[mine].tolist()), zip(near_ids[mine].tolist(), near_at[mine].tolist()))
                        parsed = factors((at[rows] - first[r]).tolist(), list(refs), window)
                    if parsed:
                        left, edge = [], 0
                        for f in parsed:
                            left += w[edge : max(edge, f["start"])]
                            edge = max(edge, f["start"] + f["length"])
                        left += w[edge:]
                        removed.append(len(w) - len(left))
                        w = left
                    else:
                        removed.append(0)
                    spans.append(parsed)
                    texts.append(b" ".join(w).decode())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(ends - first, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(texts, pa.string())],
                    names=["id", "n_words", "n_removed", "spans", "kept_text"],
                )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, spans, kept_text.

    A word is removed if a run of ``window`` words that covers it also occurs in a
    document of smaller id.  ``spans`` are the factors (start, length, ref_id,
    ref_start), in words from 0; they may overlap.  ``kept_text`` holds the words left,
    joined by one blank.

    Edge cases: null and empty texts have no words; a text of fewer than ``window``
    words stays whole; null ids rank after all others, and documents without an id are
    not compared with each other; rows that share an id are not compared with each
    other; repeats within one document stay; further columns are ignored; an empty
    table gives an empty result.  Ids must be integers above ``LEAST_ID``.
    """
    given = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text"))
    sequences = stored(given.mapInArrow(_sequence, "id long, n_words long, sequence binary"), "rlz-sequences")
    copied = stored(sequences.groupBy("sequence").agg(F.min("id").alias("whole"), F.count(F.lit(1)).alias("n")).where("n > 1"), "rlz-copied")
    hot = F.col("n") * HOT_SHARE >= sequences.count()
    often = F.broadcast(copied.where(hot).select("sequence", "whole"))  # HOT_SHARE rows at most
    seldom = sequences.join(often.select("sequence"), "sequence", "left_anti").join(copied.where(~hot).select("sequence", "whole"), "sequence")
    repeats = sequences.join(often, "sequence").unionByName(seldom).where("id > whole").select("id", "sequence", "whole").distinct()
    # of documents with an id of their own; rows that share one are parsed like any other
    single = repeats.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("whole").alias("whole"))
    shared_ids = sequences.select("id", "sequence").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("id")
    copies = single.join(shared_ids, "id", "left_anti").select("id", "whole", F.lit(False).alias("shared"))
    whole = stored(copies.unionByName(shared_ids.select("id", F.lit(None).cast("long").alias("whole"), F.lit(True).alias("shared"))), "rlz-whole")

    # the narrow sides are hashed, so that the texts keep their partitions by id, unsorted, through all three joins
    texts = given.join(whole.withColumnRenamed("id", "copy_id").hint("shuffle_hash"), F.col("id") == F.col("copy_id"), "left").select("id", "text", "whole", F.coalesce("shared", F.lit(False)).alias("shared"))
    sources = texts.where("whole is null").select("id", "text", "shared")
    beside = Window.partitionBy("anchor", "salt").orderBy("id")
    shared = (
        sources.select("id", "text").mapInArrow(_emit_anchors(window), "anchor long, salt int, id long")
        .withColumns({"prev": F.lag("id").over(beside), "next": F.lead("id").over(beside)})
        .where("salt <> 0 or prev <> id or next <> id")
    )
    asked = shared.groupBy("id").agg(F.collect_set("anchor").alias("anchors"))  # at most the anchors of one document
    holders = Window.partitionBy("print", "other").orderBy("id", "pos")
    place = F.struct("id", F.col("pos").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).cast("int").alias("at"))
    settled = F.col("other") > LEAST_ID
    found = (
        sources.join(asked.hint("shuffle_hash"), "id")
        .select("id", "text", "anchors", "shared")
        .mapInArrow(_emit_windows(window), "print long, other long, id long, pos long, ref_at int")
        .withColumns({"first": F.first(place).over(holders.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "before": F.lag(place).over(holders)})
        .withColumn("ref", F.when(settled, F.struct(F.col("other").alias("id"), F.col("ref_at").alias("at"))).otherwise(F.col("first")))
        .withColumn("near", F.when(~settled & (F.col("before.id") < F.col("id")) & (F.col("before.id") > F.col("first.id")), F.col("before")))
        .where("ref.id < id")
    )
    # a near reference only where it is another one
    entry = F.struct("pos", F.col("ref.id").alias("ref_id"), F.col("ref.at").alias("ref_at"), F.col("near.id").alias("near_id"), F.col("near.at").alias("near_at"))
    lists = found.groupBy("id").agg(F.collect_list(entry).alias("refs"))  # at most the windows of one document
    near = [F.transform("refs", lambda x: F.coalesce(x["near_id"], x["ref_id"])).alias("near_ids"), F.transform("refs", lambda x: F.coalesce(x["near_at"], x["ref_at"])).alias("near_ats")]
    parsed = (
        texts.join(lists.hint("shuffle_hash"), "id", "left")
        .select("id", "text", "whole", "shared", F.col("refs.pos").alias("places"), F.col("refs.ref_id").alias("ref_ids"), F.col("refs.ref_at").alias("ref_ats"), *near)
        .mapInArrow(_parse(window), f"id long, n_words long, n_removed long, spans {SPANS}, kept_text string")
    )
    return parsed.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), "n_words", "n_removed", "spans", "kept_text")
