"""Packing token ids into rows of fixed length by best-fit decreasing.

Documents longer than a row are split into full rows and a rest, without loss.  The
pieces are dealt into shards by a hash of document and piece.  Within a shard each
piece, longest first, goes to the open row whose free space fits it best; a segment
tree over the free capacities finds that row in logarithmic time.

Each packed row holds its ids (padded to the full length), the cumulative lengths of
its segments and the places at which positions start again at 0, one per segment;
``with_positions`` spells the positions out.

Scaling: the shuffle moves each id once.  A shard has about ``SHARD_TOKENS`` ids
whatever the size of the corpus, so a task's memory is bounded, and the loss against a
global packing is at most a few rows of each shard.  A long document is spread over
shards, which share partitions only beyond ``PARTITIONS``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.llm import words

#: Ids that one task packs at a time.
SHARD_TOKENS = 1_000_000
#: Partitions beyond which shards share them.
PARTITIONS = 100_000


class CapacityTree:
    """Counts of open rows by free space, with the smallest space of at least a size."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, space: int, row: int) -> None:
        self.open[space].append(row)
        node = self.leaves + space
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns (space, row) of the tightest open row with space >= size, or None."""
        node = self.leaves + size
        while not self.count[node]:
            # up to the first ancestor with a sibling to the right that has rows
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        space = node - self.leaves
        row = self.open[space].pop()
        while node:
            self.count[node] -= 1
            node >>= 1
        return space, row


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The row of each piece; sizes are between 1 and ``capacity``."""
    tree, rows, at = CapacityTree(capacity), 0, [0] * len(sizes)
    for piece in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        found = tree.take(sizes[piece])
        space, row = found if found else (capacity, rows)
        rows += not found
        at[piece] = row
        if space > sizes[piece]:
            tree.add(space - sizes[piece], row)
    return at


ROW = "shard long, row long, n_tokens int, ids binary, cu_seqlens array<int>, resets array<int>, doc_ids array<long>, pieces array<int>"


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column: list i has the values between ``ends[i]`` and ``ends[i + 1]``."""
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values).cast(kind))


def pack_shard(docs: pa.Array, pieces: np.ndarray, sizes: np.ndarray, ids: np.ndarray, capacity: int, pad: int) -> list[pa.Array]:
    """The columns n_tokens to pieces of the rows of one shard; ``ids`` holds the pieces' ids one after another."""
    at = np.array(best_fit_decreasing(sizes.tolist(), capacity), np.int64)
    order = np.argsort(at, kind="stable")  # pieces by row
    rows, mine, size = int(at.max()) + 1, at[order], sizes[order]
    past = np.cumsum(size)
    edges = np.searchsorted(mine, np.arange(rows + 1))  # first piece of each row
    base = np.append(0, past)[edges]  # ids before each row
    start = past - size - base[mine]  # of each piece in its row
    matrix = np.full(rows * capacity, pad, ids.dtype)
    step = np.arange(len(ids)) - np.repeat(past - size, size)
    matrix[np.repeat(mine * capacity + start, size) + step] = ids[np.repeat((np.cumsum(sizes) - sizes)[order], size) + step]
    # cumulative lengths: a 0 before each row's ends
    bounds = np.insert(start + size, edges[:-1], 0)
    bytes_ = rows * capacity * ids.dtype.itemsize
    raw = pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(np.arange(0, bytes_ + 1, capacity * ids.dtype.itemsize, dtype=np.int64)), pa.py_buffer(matrix)])
    return [
        pa.array(np.diff(base), pa.int32()),
        raw.cast(pa.binary()),
        _lists(bounds, edges + np.arange(rows + 1), pa.int32()),
        _lists(start, edges, pa.int32()),
        pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), docs.take(pa.array(order))),
        _lists(pieces[order], edges, pa.int32()),
    ]


def _pack(capacity: int, pad: int, dtype: str):
    def packed(shard: int, parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        docs, pieces, sizes, ids = zip(*parts)
        columns = pack_shard(pa.concat_arrays(docs), np.concatenate(pieces), np.concatenate(sizes), np.concatenate(ids), capacity, pad)
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(np.arange(n)), *columns], names=["shard", "row", "n_tokens", "ids", "cu_seqlens", "resets", "doc_ids", "pieces"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            shards, pieces = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            raw = batch.column(3).cast(pa.large_binary())
            ends = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8) // np.dtype(dtype).itemsize
            ids = np.frombuffer(raw.buffers()[2], dtype, int(ends[-1])) if len(raw) else np.zeros(0, dtype)
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if shards[lo] != now:
                    if held:
                        yield packed(now, held)
                    held, now = [], int(shards[lo])
                # copied, since a slice would keep its whole batch in memory
                held.append((batch.column(1).slice(lo, hi - lo), pieces[lo:hi].copy(), np.diff(ends[lo : hi + 1]), ids[ends[lo] : ends[hi]].copy()))
        if held:
            yield packed(now, held)

    return run


def _cut(capacity: int, shards: int, dtype: str):
    """(shard, doc, piece, ids) of each document's pieces; the ids are already as narrow as in the rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.asarray(batch.column(1).flatten()).astype(dtype)
            sizes = np.asarray(pa.compute.list_value_length(batch.column(1)), np.int64)
            starts, counts = np.cumsum(sizes) - sizes, -(-sizes // capacity)
            owner = np.repeat(np.arange(len(sizes)), counts)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            lo = starts[owner] + piece * capacity
            docs = batch.column(0).take(pa.array(owner))
            key = docs.fill_null(0).to_numpy().astype(np.uint64) * np.uint64(1_000_003) + piece.astype(np.uint64)
            shard = (words.mix(words.mix(key) + (flat[lo].astype(np.uint64) if len(lo) else key)) % np.uint64(shards)).astype(np.int64)
            # the pieces of a document lie one after another, so their bytes do too
            raw = pa.Array.from_buffers(pa.large_binary(), len(owner), [None, pa.py_buffer(np.append(lo, len(flat)).astype(np.int64) * flat.dtype.itemsize), pa.py_buffer(flat)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(shard), docs, pa.array(piece, pa.int32()), raw], names=["shard", "doc", "piece", "ids"])

    return run


def pack(tokens: DataFrame, capacity: int = 2048, pad: int = 0, vocabulary: int = 50_257, shards: int | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Packed rows: shard, row, n_tokens, ids, cu_seqlens, resets, doc_ids, pieces.

    ``ids`` is the raw row of ``capacity`` ids (16-bit little-endian up to a vocabulary
    of 65,536, else 32-bit), padded by ``pad``; positions are 0 again at each
    of ``resets``; segment s is the piece ``pieces[s]`` of document ``doc_ids[s]`` and lies
    between ``cu_seqlens[s]`` and ``cu_seqlens[s + 1]``.  ``shards`` defaults to all
    tokens over ``SHARD_TOKENS``.

    Edge cases: documents without ids (null or empty) take no place; null ids of
    documents are carried; repeated rows are packed each; further columns are
    ignored; an empty table gives an empty result.  Rows are in the same place at each
    rerun over the same rows.
    """
    given = tokens.select(F.col(id_col).cast("long").alias("doc"), F.col(ids_col).alias("all_ids")).where(F.size("all_ids") > 0)
    if shards is None:
        shards = max(1, -(-(given.agg(F.sum(F.size("all_ids").cast("long")).alias("n")).first()["n"] or 0) // SHARD_TOKENS))
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    cut = given.mapInArrow(_cut(capacity, shards, dtype), "shard long, doc long, piece int, ids binary")
    dealt = cut.repartition(min(shards, PARTITIONS), "shard").sortWithinPartitions("shard", "doc", "piece", "ids")
    return dealt.mapInArrow(_pack(capacity, pad, dtype), ROW)


def with_positions(rows: DataFrame) -> DataFrame:
    """``rows`` with ``positions``: the position of each id within its segment (padding left out)."""
    spans = F.transform(F.arrays_zip("resets", F.expr("slice(cu_seqlens, 2, size(resets))").alias("ends")), lambda s: F.sequence(F.lit(0), s["ends"] - s["resets"] - 1))
    return rows.withColumn("positions", F.flatten(spans))


def unpack(rows: DataFrame, vocabulary: int = 50_257) -> DataFrame:
    """(doc_id, piece, ids) of all segments: the inverse of ``pack``."""
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, pieces, ids = [], [], []
            for raw, ends, d, p in zip(*(batch.column(c).to_pylist() for c in ("ids", "cu_seqlens", "doc_ids", "pieces"))):
                row = np.frombuffer(raw, dtype).astype(np.int32)
                docs += d
                pieces += p
                ids += [row[a:b] for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(pieces, pa.int32()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "piece", "ids"])

    return rows.mapInArrow(run, "doc_id long, piece int, ids array<int>")
