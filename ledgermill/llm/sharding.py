"""Shards of equal bytes by histogram sort.

Documents are ordered by (hash of the text, id), which mixes sources and keeps equal
texts side by side.  The borders of the shards are searched for without sorting: each
round draws candidate keys from the stretches of the order in which a border must lie,
at a rate that the number of rows there sets, counts exactly the bytes below every
candidate over all partitions, and keeps the two candidates around each border's goal
as the next stretch.  A border is settled once a candidate misses its goal by no more
than the tolerance, or when every key of its stretch has been a candidate; then the
nearest one is taken.  With all borders settled the rows are exchanged once.

The rounds read a narrow table of keys and sizes.  Only candidates (some dozens a
border) and their counts reach the driver.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ledgermill.llm.shared import stored
from ledgermill.llm.words import mix

#: Candidates drawn from a border's stretch in a round, on average; a stretch of so many rows is drawn whole.
DRAWN, WHOLE = 64, 256
#: Rows that a task numbers after the exchange, about.
PIECE_ROWS = 1_000_000

_SIGN = np.uint64(1 << 63)
ALL = 2**64 - 1


@dataclass(frozen=True)
class Candidate:
    """A key of the order, and what lies below it."""

    key: bytes
    size: int
    rows: int
    between_groups: bool


def order_keys(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """16 bytes each, whose order is that of two signed numbers."""
    both = np.empty((len(high), 2), ">u8")
    both[:, 0], both[:, 1] = high.view(np.uint64) ^ _SIGN, low.view(np.uint64) ^ _SIGN
    return np.ascontiguousarray(both).view("S16").ravel()


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.asarray(batch.column(i)) for i in range(3))


def _count(keys: np.ndarray) -> Callable:
    """Per task: (bin, bytes, rows) of what lies between neighbouring ``keys``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(keys) + 1, np.int64), np.zeros(len(keys) + 1, np.int64)
        for batch in batches:
            high, low, sizes = _columns(batch)
            bins = np.searchsorted(keys, order_keys(high, low), "right")
            size += np.bincount(bins, sizes, len(size)).astype(np.int64)  # a batch's bytes are far below the 53 bits of a double
            rows += np.bincount(bins, minlength=len(rows))
        held = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(size[held]), pa.array(rows[held])], names=["bin", "size", "rows"])

    return run


def _draw(borders: np.ndarray, rates: np.ndarray) -> Callable:
    """Per batch: the keys (high, low) whose own hash is below the rate of the stretch they lie in."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, low, _ = _columns(batch)
            rate = rates[np.searchsorted(borders, order_keys(high, low), "right")]
            lot = mix(high.view(np.uint64) ^ mix(low.view(np.uint64) + np.uint64(1)))
            drawn = np.flatnonzero((lot < rate) | (rate == np.uint64(ALL)))
            yield pa.RecordBatch.from_arrays([pa.array(high[drawn]), pa.array(low[drawn])], names=["high", "low"])

    return run


def _starts(high: int, low: int) -> list[tuple[bytes, bool]]:
    """The key of a row, and the first possible keys of its group of equal texts and of the next one."""
    encode = lambda h, d: (h + (1 << 63)).to_bytes(8, "big") + (d + (1 << 63)).to_bytes(8, "big")
    least = -(1 << 63)
    out = [(encode(high, low), low == least), (encode(high, least), True)]
    return out + ([(encode(high + 1, least), True)] if high < (1 << 63) - 1 else [])


def borders(keyed: DataFrame, shards: int, tolerance: float = 0.002) -> list[bytes]:
    """The keys at which shards 1, 2, ... begin, of (high, low, size).

    Goals are equal parts of all bytes.  Among candidates within ``tolerance`` of a
    shard's bytes one that parts no group of equal texts goes first, then the nearest.
    """
    total, rows = (int(x or 0) for x in keyed.agg(F.sum("size"), F.count(F.lit(1))).first())
    if not rows:
        return [b""] * (shards - 1)
    goals = [total * i // shards for i in range(1, shards)]
    known = [Candidate(b"", 0, 0, True), Candidate(b"\xff" * 17, total, rows, True)]  # below and above all keys
    spare, settled, whole, tries = total / shards * tolerance, {}, set(), Counter()
    while len(settled) < len(set(goals)):
        sizes, stretches = [c.size for c in known], {}
        for goal in set(goals) - set(settled):
            upper = known[bisect_left(sizes, goal)]
            lower = known[max(bisect_left(sizes, goal) - 1, 0)]
            clean = [c for c in known[bisect_left(sizes, goal - spare) : bisect_right(sizes, goal + spare)] if c.between_groups]
            if clean or lower.key in whole or upper.rows == lower.rows:
                settled[goal] = min(clean or [lower, upper], key=lambda c: (abs(c.size - goal), c.key))
            else:
                stretches[lower.key] = (upper.key, upper.rows - lower.rows)
        if stretches:
            known = _refine(keyed.select("high", "low", "size"), known, stretches, whole, tries)
    return [settled[g].key for g in goals]


def _refine(narrow: DataFrame, known: list[Candidate], stretches: dict[bytes, tuple[bytes, int]], whole: set[bytes], tries: Counter) -> list[Candidate]:
    """``known`` with candidates from ``stretches`` (lower key: upper key, rows) counted.

    ``whole`` gains the candidates of stretches that hold no other key; a stretch drawn
    again (its rows may all have one key) is drawn at eight times the rate.
    """
    edges = sorted({*stretches, *[upper for upper, _ in stretches.values()]})
    rates, full = np.zeros(len(edges) + 1, np.uint64), set()
    for n, key in enumerate(edges, 1):
        if key in stretches:
            upper, inside = stretches[key]
            drawn = DRAWN * 8 ** tries[key, upper]
            tries[key, upper] += 1
            if inside <= max(WHOLE, drawn):
                full.add(key)
            rates[n] = ALL if key in full else drawn * 2**64 // inside
    found: dict[bytes, bool] = {}
    for r in narrow.mapInArrow(_draw(np.array(edges, "S17"), rates), "high long, low long").distinct().collect():  # some dozens a border
        for key, clean in _starts(r["high"], r["low"]):
            found[key] = clean or found.get(key, False)
    counted = {c.key: c for c in known}
    keys = sorted({*found, *counted} - {known[0].key, known[-1].key})
    sums = narrow.mapInArrow(_count(np.array(keys, "S16")), "bin long, size long, rows long").groupBy("bin").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows"))
    bins = {r["bin"]: (r["size"], r["rows"]) for r in sums.collect()}
    size = rows = 0
    for n, key in enumerate(keys):
        more = bins.get(n, (0, 0))
        size, rows = size + more[0], rows + more[1]
        counted.setdefault(key, Candidate(key, size, rows, found.get(key, False)))
    out = sorted(counted.values(), key=lambda c: c.key)
    whole.update(c.key for lower in full for c in out if lower <= c.key < stretches[lower][0])
    return out


def _shard_of(cuts: np.ndarray) -> Callable:
    """Per batch: the rows in their order with their shard, the task, and their place among the task's rows of the shard."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, held = TaskContext.get().partitionId(), {}
        for batch in batches:
            names = batch.schema.names
            high, low = (np.asarray(batch.column(names.index(c))) for c in ("high", "low"))
            shard = np.searchsorted(cuts, order_keys(high, low), "right")
            first = np.flatnonzero(np.diff(shard, prepend=-1))  # rows come sorted, so a shard's are together
            place = np.arange(len(shard)) - np.repeat(first, np.diff(np.append(first, len(shard))))
            place = place + np.array([held.get(s, 0) for s in shard[first]], np.int64).repeat(np.diff(np.append(first, len(shard))))
            for s, n in zip(*np.unique(shard, return_counts=True)):
                held[s] = held.get(s, 0) + int(n)
            more = [pa.array(shard.astype(np.int32)), pa.array(np.full(len(shard), piece, np.int32)), pa.array(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*names, "shard", "piece", "place"])

    return run


def keyed_documents(docs: DataFrame, id_col: str, text_col: str, overhead: int, carried: list[Column]) -> DataFrame:
    """``carried`` columns with (high, low, size): the hash of the text, the id as a number, the bytes and ``overhead``."""
    text, doc = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col)
    number = doc.cast("long") if isinstance(docs.schema[id_col].dataType, IntegralType) else F.xxhash64(doc)
    least = F.lit(-(1 << 63)).cast("long")
    return docs.select(*carried, F.xxhash64(text).alias("high"), F.coalesce(F.when(doc.isNotNull(), number), least).alias("low"), (F.octet_length(text).cast("long") + F.lit(overhead)).alias("size"))


def dealt(keyed: DataFrame, cuts: list[bytes]) -> DataFrame:
    """The rows of ``keyed`` with (shard, slot): exchanged once into the order of the shards, stored, and numbered from 0 in each."""
    conf, n = keyed.sparkSession.conf, keyed.count()
    pieces = max(int(conf.get("spark.sql.shuffle.partitions")), -(-n // PIECE_ROWS))
    ordered = keyed.repartitionByRange(pieces, "high", "low").sortWithinPartitions("high", "low")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in keyed.schema)}, shard int, piece int, place long"
    rows = stored(ordered.mapInArrow(_shard_of(np.array(cuts, "S16")), schema), "shards")
    held = rows.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows.join(F.broadcast(starts), ["shard", "piece"]).withColumn("slot", F.col("place") + F.col("start")).drop("piece", "place", "start")  # a row per task and border


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, tolerance: float = 0.002) -> DataFrame:
    """(id, size, text_crc32, shard, slot): every document's shard of about equal bytes, and its place there from 0.

    A size is the UTF-8 bytes of the text and ``overhead``; a null text counts as an
    empty one.  Shards are stretches of the order by (hash of the text, id), null ids
    first.  A group of equal texts is parted only where a border falls into it and no
    border beside it is within the tolerance; rows equal in text and id stay together.
    With few documents shards may be empty; an empty table gives no row.  Further
    columns take no part.
    """
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")))
    keyed = stored(keyed_documents(docs, id_col, text_col, overhead, [F.col(id_col).alias("id"), crc.alias("text_crc32")]), "shard-keys")
    return dealt(keyed, borders(keyed, shards, tolerance)).select("id", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, tolerance: float = 0.002) -> DataFrame:
    """Writes ``docs``, all columns kept, to ``path`` in a folder a shard, rows in order of ``__slot``; returns the table."""
    spark, names = docs.sparkSession, docs.columns
    plain = docs.toDF(*[f"c{n}" for n in range(len(names))])  # no name can clash
    keys = (f"c{names.index(id_col)}", f"c{names.index(text_col)}", overhead)
    cuts = borders(stored(keyed_documents(plain, *keys, []), "shard-keys"), shards, tolerance)
    rows = dealt(keyed_documents(plain, *keys, [F.col(c) for c in plain.columns]), cuts)
    rows.select(*[F.col(c).alias(n) for c, n in zip(plain.columns, names)], F.col("shard").alias("__shard"), F.col("slot").alias("__slot")).write.partitionBy("__shard").parquet(path)
    return spark.read.parquet(path)
