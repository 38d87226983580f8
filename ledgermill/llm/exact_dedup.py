"""Exact duplicates by an extendible-hash index on shared files.

A directory maps the leading bits of a text's hash key to a bucket; while a bucket
holds more bytes of text than its capacity, the directory doubles and the bucket
splits.  Each bucket is a contiguous range of keys with one owner task.  The texts are
dealt to their buckets; the owner orders its range, chains the texts whose keys are
equal, compares their bytes along the chain and so finds smallest id, number of rows
and digest of each distinct text.  These entries are the index; the rows look theirs up.

Scaling: equal texts that are read together are combined before the shuffle, so a text
repeated in a third of all rows reaches its owner once per batch of rows.  Each text is
shuffled once, an owner streams through its sorted range and holds one chain at a time.
The directory has at most ``2 ** MAX_DEPTH`` cells whatever the size of the corpus.
Lookups join narrow rows; texts with more than ``1 / HOT_SHARE`` of all rows are looked
up in a broadcast of at most that many entries, so no join key has more rows than that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ledgermill.llm.shared import stored

#: Depth at which the directory stops to double: it has 65,536 cells at most.
MAX_DEPTH = 16
#: Bytes of text in a bucket beyond which it splits.
CAPACITY = 1 << 20
#: There are at most so many texts that each have this part of all rows or more.
HOT_SHARE = 1000
_WHITE = b" \t\n\v\f\r"


def grow_directory(cells: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> list[tuple[int, int, int]]:
    """(first cell, number of cells, local depth) of each bucket, in key order.

    ``cells`` counts the keys by their leading ``max_depth`` bits.  Starting from one
    bucket, the directory doubles as long as a bucket is overfull and can be split.
    """
    buckets, depth = [(0, 0)], 0  # (prefix, local depth)
    held = {(0, 0): sum(cells.values())}
    while depth < max_depth and any(held[b] > capacity and b[1] == depth for b in buckets):
        depth += 1
        at_depth: dict[int, int] = {}
        for cell, n in cells.items():
            prefix = cell >> (max_depth - depth)
            at_depth[prefix] = at_depth.get(prefix, 0) + n
        grown = []
        for prefix, local in buckets:
            if local == depth - 1 and held[prefix, local] > capacity:
                for half in (2 * prefix, 2 * prefix + 1):
                    held[half, depth] = at_depth.get(half, 0)
                    grown.append((half, depth))
            else:
                grown.append((prefix, local))
        buckets = grown
    return [(prefix << (max_depth - local), 1 << (max_depth - local), local) for prefix, local in buckets]


def normal(raw: bytes) -> bytes:
    """The UTF-8 text with each run of white space replaced by one blank."""
    words = raw.split()  # of bytes: at exactly the six separators
    if not words:
        return raw[:1] and b" "
    return (b" " if raw[0] in _WHITE else b"") + b" ".join(words) + (b" " if raw[-1] in _WHITE else b"")


def _key(text: bytes, bits: int) -> int:
    """The hash key of a normalised text, signed; its lower 64 - bits bits are 0."""
    key = xxhash.xxh3_64_intdigest(text) >> (64 - bits) << (64 - bits)
    return key - 2**64 if key >> 63 else key


def _texts(column: pa.Array) -> list[bytes]:
    return [normal(t or b"") for t in column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def _keys(bits: int):
    """(id, text) to (id, key, size, text_sha256)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column(1))
            columns = [pa.array([_key(t, bits) for t in texts], pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "key", "size", "text_sha256"])

    return run


def _before(a: object, b: object) -> bool:
    """Whether id a comes before id b; null comes last."""
    return a is not None and (b is None or a < b)


def _deal(directory: list[tuple[int, int, int]], bits: int, id_at: int, text_at: int):
    """Adds (bucket, key, n): of the rows of a batch with equal text one with the smallest id, and their number."""
    first_cells = np.array([first for first, _, _ in directory])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, seen = batch.column(id_at).to_pylist(), {}
            for r, text in enumerate(_texts(batch.column(text_at))):
                found = seen.setdefault(text, [r, 0])
                found[1] += 1
                if _before(ids[r], ids[found[0]]):
                    found[0] = r
            keys = np.array([_key(t, bits) for t in seen], np.int64)
            buckets = np.searchsorted(first_cells, (keys.view(np.uint64) >> np.uint64(64 - MAX_DEPTH)).astype(np.int64), "right") - 1
            rows = batch.take(pa.array([r for r, _ in seen.values()], pa.int64()))
            added = [pa.array(buckets.astype(np.int32)), pa.array(keys), pa.array([n for _, n in seen.values()], pa.int64())]
            yield pa.RecordBatch.from_arrays([*added, *rows.columns], names=["bucket", "key", "n", *batch.schema.names])

    return run


def _chains(batches: Iterable[pa.RecordBatch], id_at: int, text_at: int) -> Iterator[list[list]]:
    """Chains [text, id, n, row, bucket, key] of equal keys, from rows in order of their keys."""
    chain, now = [], None
    for batch in batches:
        buckets, keys, counts, ids = (batch.column(c).to_pylist() for c in (0, 1, 2, 3 + id_at))
        for r, text in enumerate(_texts(batch.column(3 + text_at))):
            if keys[r] != now:
                if chain:
                    yield chain
                chain, now = [], keys[r]
            for entry in chain:
                if entry[0] == text:  # whole texts, byte by byte
                    entry[2] += counts[r]
                    if _before(ids[r], entry[1]):
                        entry[1], entry[3] = ids[r], (batch, r)
                    break
            else:
                chain.append([text, ids[r], counts[r], (batch, r), buckets[r], keys[r]])
    if chain:
        yield chain


def _batched(chains: Iterable[list[list]], most: int = 4096) -> Iterator[list[tuple[int, list]]]:
    """Lists of about ``most`` (place in the chain, entry)."""
    held = []
    for chain in chains:
        held += enumerate(chain)
        if len(held) >= most:
            yield held
            held = []
    if held:
        yield held


def _entries(kind: pa.DataType):
    """The index entries of an owner's texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _batched(_chains(batches, 0, 1)):
            columns = [
                pa.array([e[4] for _, e in held], pa.int32()),
                pa.array([e[5] for _, e in held], pa.int64()),
                pa.array([c for c, _ in held], pa.int32()),
                pa.array([e[1] for _, e in held], kind),
                pa.array([e[2] for _, e in held], pa.int64()),
                pa.array([hashlib.sha256(e[0]).hexdigest() for _, e in held], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "key", "chain", "keep_id", "group_size", "text_sha256"])

    return run


def _first_rows(names: list[str], id_at: int, text_at: int):
    """The row with the smallest id of each of an owner's texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _batched(_chains(batches, id_at, text_at)):
            rows = pa.Table.from_batches([e[3][0].slice(e[3][1], 1) for _, e in held]).combine_chunks()
            yield from rows.select(list(range(3, rows.num_columns))).rename_columns(names).to_batches()

    return run


def _dealt(docs: DataFrame, cells: DataFrame, capacity: int, bits: int, id_at: int, text_at: int) -> DataFrame:
    """(bucket, key, n, columns of docs), each bucket in one task in order of key; ``cells``: (cell, size)."""
    # at most 2 ** MAX_DEPTH sums reach the driver
    sizes = {r["cell"]: r["size"] for r in cells.groupBy("cell").agg(F.sum("size").alias("size")).collect()}
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), *docs.schema.fields])
    combined = docs.mapInArrow(_deal(grow_directory(sizes, capacity), bits, id_at, text_at), schema)
    return combined.repartition("bucket").sortWithinPartitions("bucket", "key")


def _cell(key: str) -> Column:
    return F.shiftrightunsigned(F.col(key), 64 - MAX_DEPTH).cast("int")


def _keyed(docs: DataFrame, id_col: str, text_col: str, bits: int) -> tuple[DataFrame, DataFrame]:
    """(id, text) of ``docs``, and (id, key, size, text_sha256) of each row."""
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([given.schema["id"], T.StructField("key", T.LongType()), T.StructField("size", T.LongType()), T.StructField("text_sha256", T.StringType())])
    return given, given.mapInArrow(_keys(bits), schema)


def _index(given: DataFrame, keyed: DataFrame, capacity: int, bits: int) -> DataFrame:
    kind = given.schema["id"].dataType
    owned = _dealt(given, keyed.select(_cell("key").alias("cell"), "size"), capacity, bits, 0, 1)
    return stored(owned.mapInArrow(_entries(to_arrow_type(kind)), f"bucket int, key long, chain int, keep_id {kind.simpleString()}, group_size long, text_sha256 string"), "exact-index")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, key_bits: int = 64) -> DataFrame:
    """Entries (bucket, key, chain, keep_id, group_size, text_sha256) of all distinct texts, on shared files.

    ``chain`` numbers the entries of equal key, so it is above 0 only for colliding
    keys.  ``key_bits`` below 64 is for tests of collisions.
    """
    return _index(*_keyed(docs, id_col, text_col, key_bits), capacity, key_bits)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, key_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical after replacing each run of white space by
    one blank.  Of equal texts the row with the smallest id stays.

    Edge cases: a null text counts as empty; empty texts are copies of each other;
    null ids rank after all others, and a group of null ids only keeps one of them
    (its keep_id is null); a row that repeats both id and text is a copy like any
    other, so exactly one of them is kept; further columns are ignored; an empty table
    gives an empty result.
    """
    given, keyed = _keyed(docs, id_col, text_col, key_bits)
    rows = stored(keyed, "exact-keys")
    index = _index(given, rows, capacity, key_bits)
    place = ["key", "text_sha256"]
    found = index.select(*place, "keep_id", "group_size")
    hot = (found["group_size"] * HOT_SHARE >= rows.count()) & (found["group_size"] > 1)
    often = F.broadcast(found.where(hot))  # HOT_SHARE entries at most
    looked_up = rows.join(often, place).unionByName(rows.join(often.select(*place), place, "left_anti").join(found.where(~hot), place))
    same = Window.partitionBy("id", "text_sha256").orderBy("key")
    return looked_up.withColumn("turn", F.row_number().over(same)).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; edge cases as in ``exact_duplicates``.

    The owners of the index hand over the rows themselves, so no join follows.
    """
    names = docs.columns
    numbered = docs.toDF(*[f"c{n}" for n in range(len(names))])  # no name can clash
    _, keyed = _keyed(docs, id_col, text_col, 64)
    id_at, text_at = names.index(id_col), names.index(text_col)
    owned = _dealt(numbered, keyed.select(_cell("key").alias("cell"), "size"), capacity, 64, id_at, text_at)
    return owned.mapInArrow(_first_rows(numbered.columns, id_at, text_at), numbered.schema).toDF(*names)
