"""Near duplicates by fast similarity sketching, banding and exact verification.

A sketch has ``SIZE`` coordinates.  In round i each element of a set hashes to one
coordinate and a value; the coordinate keeps the smallest (round, value).  After
``SIZE`` rounds, round SIZE + j places every element into coordinate j, so each
coordinate fills for certain; a set stops as soon as all are filled, which large sets
reach within a few rounds.  Equal coordinates estimate the Jaccard similarity with
the concentration of independent samples (Dahlgaard, Knudsen and Thorup, 2017).

Stages: (1) shingle sets, sketches and class keys of all texts; texts of equal sets
form one class.  (2) Class representatives meet in bands of coordinates.  (3) Within a
band bucket, members whose estimated similarity is at most ``SLACK`` under the
threshold are joined to families.  (4) Each family's full sets are compared, pair by pair unless
already connected, and links at the threshold are exact.  (5) Components of links.

At a threshold of 0.85 there are 24 bands of 5, below it 30 bands of 4.  A pair at 0.85
shares no band with probability 8e-7, one at 0.8 with 2e-7; both fall under the screen
in less than 1 of 100,000 cases, and all these chances fall fast with rising similarity.

Scaling: copies are collapsed before any pairing.  Band rows and edges are narrow.
Buckets are streamed in blocks of ``BLOCK`` members; families over a block are dealt
out as pairs of blocks, so no task holds an unbounded group and no pair is skipped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgermill.llm import words
from ledgermill.llm.components import connected_components
from ledgermill.llm.shared import stored

SHINGLE = 5
SIZE = 120
#: How far the estimated similarity of a compared pair may lie under the threshold; over 4 deviations.
SLACK = 0.17
#: Members of a bucket or family, and elements of a family, that one task holds at a time.
BLOCK = 2048
BLOCK_ELEMENTS = 4_000_000

_U = np.uint64
_EMPTY = _U(2**64 - 1)
_FORM = np.random.default_rng(78).integers(1, 2**63, SIZE, dtype=np.uint64) * _U(2) + _U(1)


def fast_sketch(elements: np.ndarray, owner: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """Sketches (n x size) of n sets; ``elements[k]`` belongs to set ``owner[k]``."""
    flat = np.full(n * size, _EMPTY)
    live, mine = elements, owner.astype(np.int64)
    for i in range(2 * size):
        if not len(live):
            break
        h = words.mix(live + words.mix(np.array([i + 1], np.uint64)))  # round i's hash function
        place = ((h >> _U(32)) * _U(size) >> _U(32)).astype(np.int64) if i < size else np.full(len(live), i - size)
        np.minimum.at(flat, mine * size + place, (_U(i) << _U(32)) | (h & _U(0xFFFFFFFF)))
        open_ = (flat.reshape(n, size) == _EMPTY).any(axis=1)[mine]
        live, mine = live[open_], mine[open_]
    return flat.reshape(n, size)


def band_keys(sketches: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band of SIZE / bands coordinates; different bands have different keys."""
    mixed = (words.mix(sketches) * _FORM).reshape(len(sketches), bands, SIZE // bands)
    return words.mix(mixed.sum(axis=2, dtype=np.uint64) + _FORM[:bands]).view(np.int64)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(lo, hi, sorted sets of distinct shingle fingerprints) for ranges of documents."""
    for lo, hi in words.slices(offsets):
        found, counts = words.hash_words(raw, offsets[lo:hi], offsets[lo + 1 : hi + 1], lower=True)
        ends = np.cumsum(counts)
        yield lo, hi, [np.unique(words.windows(found[e - k : e], min(size, k))) if k else found[:0] for e, k in zip(ends.tolist(), counts.tolist())]


def _sketches(sets: list[np.ndarray]) -> np.ndarray:
    sizes = np.array([len(s) for s in sets], np.int64)
    joined = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return fast_sketch(joined, np.repeat(np.arange(len(sets)), sizes), len(sets))


def _profile(size: int, bands: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = words.text_column(batch.column(1))
            for lo, hi, sets in shingle_sets(raw, offsets, size):
                sketches = _sketches(sets)
                keys = band_keys(sketches, bands)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * bands, pa.int32()), pa.array(keys.ravel())),
                        pa.array([row.tobytes() for row in (words.mix(sketches) >> _U(56)).astype(np.uint8)], pa.binary()),
                    ],
                    names=["id", "n_shingles", "class", "keys", "sketch"],
                )

    return run


def _runs(batches: Iterable[pa.RecordBatch], keys: int, most: int) -> Iterator[tuple[tuple, bool, list[tuple]]]:
    """(key, first block of its key, rows) of batches sorted by their first ``keys`` columns."""
    held: list[tuple] = []
    key, first = None, True
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != key or len(held) >= most:
                if held:
                    yield key, first, held
                first, key, held = row[:keys] != key, row[:keys], []
            held.append(row[keys:])
    if held:
        yield key, first, held


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def _families(screen: float):
    """Spanning edges of the screened similarity graph of each bucket (key, rep, sketch)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        leader = None
        seeds: list[int] = []  # of the first block of a bucket, until a second one follows
        for _, first, rows in _runs(batches, 1, BLOCK):
            ids = [r[0] for r in rows]
            if first:
                seeds = []
            else:  # a further block of a large bucket: one family with all that came before
                out.append((leader, ids[0]))
                out.extend((leader, s) for s in seeds)
                seeds = []
            leader = ids[0]
            marks = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), SIZE)
            left = np.arange(len(rows))
            while len(left):
                seed, left = left[0], left[1:]
                if seed and first:
                    seeds.append(ids[seed])
                elif seed:
                    out.append((leader, ids[seed]))
                stack = [seed]
                while stack and len(left):
                    near = (marks[left] == marks[stack.pop()]).mean(axis=1) >= screen
                    out.extend((ids[seed], ids[x]) for x in left[near])
                    stack.extend(left[near])
                    left = left[~near]
            if len(out) >= 10_000:
                yield _edges(out)
                out = []
        yield _edges(out)

    return run


def _full_sets(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = words.text_column(batch.column(2))
            for lo, hi, sets in shingle_sets(raw, offsets, size):
                marks = (words.mix(_sketches(sets)) >> _U(56)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                        pa.array([m.tobytes() for m in marks], pa.binary()),
                    ],
                    names=["rep", "family", "n", "elements", "sketch"],
                )

    return run


def _verify(percent: int):
    screen = percent / 100 - SLACK

    def links(rows: list[tuple], cross: bool) -> Iterator[tuple[int, int]]:
        """Spanning links of the rows (block, rep, elements, sketch); only between blocks if ``cross``."""
        ids, blocks = [r[1] for r in rows], np.array([r[0] for r in rows])
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        sizes = np.array([len(s) for s in sets])
        marks = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), SIZE)
        root = list(range(len(rows)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x in range(len(rows) - 1):
            later = np.arange(x + 1, len(rows))
            small, large = np.minimum(sizes[later], sizes[x]), np.maximum(sizes[later], sizes[x])
            later = later[100 * small >= percent * large]
            if cross:
                later = later[blocks[later] != blocks[x]]
            alike = (marks[later] == marks[x]).mean(axis=1)
            later, alike = later[alike >= screen], alike[alike >= screen]
            for y in later[np.argsort(-alike, kind="stable")].tolist():
                p, q = find(x), find(y)
                if p != q:
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                        root[q] = p
                        yield ids[x], ids[y]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for (_, i, j), _, rows in _runs(batches, 3, 2**31):  # two blocks at most
            out.extend(links(rows, i != j))
            if len(out) >= 10_000:
                yield _edges(out)
                out = []
        yield _edges(out)

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, size: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Words are runs of non-white bytes, A-Z lower-cased; a document's set holds its
    distinct ``size``-word shingles (the whole sequence if it has fewer words), each as
    a 64-bit fingerprint.  Documents with 100 * intersection >= percent * union are
    linked; component_id is the smallest id reachable.

    Edge cases: null or empty texts and texts of white space have an empty set and are
    linked with nothing; a null id gives a null component_id and is not kept, and links
    nothing; repeated rows share their component (all kept, if theirs is the smallest
    id); ids must be integers; further columns are ignored; an empty table gives an
    empty result.
    """
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    profiles = stored(given.mapInArrow(_profile(size, 24 if percent >= 85 else 30), "id long, n_shingles long, class binary, keys array<long>, sketch binary"), "near-profiles")
    usable = profiles.where("n_shingles > 0 and id is not null")
    classes = stored(usable.groupBy("class").agg(F.min("id").alias("rep")), "near-classes")
    reps = usable.join(classes, (usable["class"] == classes["class"]) & (usable["id"] == classes["rep"])).select("rep", "keys", "sketch")
    reps = stored(reps, "near-reps")

    keyed = reps.select("rep", F.explode("keys").alias("key"))
    beside = Window.partitionBy("key").orderBy("rep")
    shared = keyed.withColumns({"prev": F.lag("rep").over(beside), "next": F.lead("rep").over(beside)}).where("prev is not null or next is not null").select("key", "rep")
    buckets = shared.join(reps.select("rep", "sketch"), "rep").select("key", "rep", "sketch").repartition("key").sortWithinPartitions("key", "rep")
    family = connected_components(buckets.mapInArrow(_families(percent / 100 - SLACK), "a long, b long"), "near-families")
    family = family.select(F.col("node").alias("rep"), F.col("component").alias("family"))

    texts = given.join(family, given["id"] == family["rep"]).select("rep", "family", "text")
    members = stored(texts.mapInArrow(_full_sets(size), "rep long, family long, n long, elements binary, sketch binary"), "near-sets")
    extent = members.groupBy("family").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_ELEMENTS), F.ceil(F.count(F.lit(1)) / BLOCK)).cast("int").alias("blocks"))
    dealt = (
        members.join(extent, "family")
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "elements", "sketch")
        .repartition("family", "i", "j")
        .sortWithinPartitions("family", "i", "j", "rep")
    )
    linked = connected_components(dealt.mapInArrow(_verify(percent), "a long, b long"), "near-links")
    found = profiles.select("id", "n_shingles", "class").join(classes, "class", "left").join(linked, F.col("rep") == linked["node"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep", "id")).otherwise(F.col("id"))
    return found.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id")).withColumn("component_id", F.when(F.col(id_col).isNotNull(), F.col("component_id"))).withColumn(
        "kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False))
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """The rows of ``docs`` whose document stays, with all their columns; rows without an id stay."""
    gone = near_duplicates(docs, id_col, text_col, percent).where(~F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
