"""Byte-level BPE over texts of any length, in overlapping chunks.

A text longer than ``CHUNK`` characters is cut into chunks that overlap by
``OVERLAP``.  All chunks are pre-tokenised in parallel.  A chunk that starts amid a
pre-token is out of step at first; where it finds a pre-token border that the chunk
before it found too, both go on alike from there, since a match of the pattern depends
on what follows only.  The ids of a pre-token depend on it alone, so each chunk is
encoded in the same pass, with its borders; the stitches then say which of its ids
belong to the piece between them, and the pieces are put together in order.  A text
with a seam that finds no common border (one pre-token over the whole overlap) is
encoded as one piece.  Shorter texts are a single piece each, without any shuffle.

Scaling: a short text is read and encoded where it lies; a long one is moved as chunks
and once more with its ids, to be put together.

Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

CHUNK = 1 << 15
OVERLAP = 1 << 10
#: Characters that the pattern may look at beyond the end of a match.
AHEAD = 4
#: Pre-tokens whose ids a worker keeps.
CACHED = 200_000
#: Tokens that a worker hands over at a time.
BATCH_TOKENS = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class _Ids(dict):
    """Ids of pre-tokens as bytes of 32-bit integers, filled on demand; bounded."""

    def __init__(self, path: str):
        # a pattern that takes any text as one piece, so that only the merges are the library's
        self._one = _library(path, "(?s:.+)")

    def __missing__(self, piece: str) -> bytes:
        found = array("i", self._one(piece)).tobytes()
        if len(self) >= CACHED:
            self.clear()
        self[piece] = found
        return found


def _library(path: str, pattern: str) -> Callable[[str], list[int]]:
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={}).encode_ordinary


_LOADED: dict[tuple[str, str], tuple[regex.Pattern, _Ids, Callable[[str], list[int]]]] = {}


def _tools(path: str, pattern: str) -> tuple[regex.Pattern, _Ids, Callable[[str], list[int]]]:
    """Pattern, ids of pre-tokens, ids of a piece; made once per worker process."""
    key = (path, pattern)
    if key not in _LOADED:
        _LOADED[key] = regex.compile(pattern), _Ids(path), _library(path, pattern)
    return _LOADED[key]


def encode_text(text: str, path: str, pattern: str) -> array:
    """Ids of one text (32-bit); the plain building block of the operator.

    A text beyond a chunk (one that finds no common border) goes pre-token by pre-token,
    so that no call holds more than one of them.
    """
    find, ids, whole = _tools(path, pattern)
    if len(text) <= CHUNK + OVERLAP:
        return array("i", whole(text))
    return array("i", b"".join(map(ids.__getitem__, find.findall(text))))


def _id_lists(parts: list[array]) -> pa.ListArray:
    """An Arrow list column of the ids in each part."""
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def _encode_batches(path: str, pattern: str, schema: pa.Schema):
    """(id, text) to (id, ids), and the bytes of the ids if the schema has a third column."""
    decoded = len(schema) > 2

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, lists, held = 0, [], 0
            for r, text in enumerate(batch.column(1)):
                lists.append(encode_text(text.as_py(), path, pattern))
                held += len(lists[-1])
                if held >= BATCH_TOKENS or r == batch.num_rows - 1:
                    given = batch.column(0).slice(lo, r + 1 - lo).cast(schema.field(0).type)
                    yield pa.RecordBatch.from_arrays([given, _id_lists(lists), *([_bytes_of(lists, path)] if decoded else [])], schema=schema)
                    lo, lists, held = r + 1, [], 0

    return run


def _bytes_of(parts: list[array], path: str) -> pa.BinaryArray:
    names = _names(path)
    return pa.array([b"".join(names[np.frombuffer(p, np.int32)].tolist()) for p in parts], pa.binary())


def _encode_chunks(path: str, pattern: str, chunk: int, overlap: int):
    """Adds to each chunk (id, row, k, last, chunk) its ids, and the borders in its head and tail.

    A border is a position in the text with the number of ids before it in the chunk;
    the last ones, which a longer text could change, are left out unless the text ends.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, ids, _ = _tools(path, pattern)
        for batch in batches:
            lists, sides = [], ([], [], [], [])
            for k, last, text in zip(*(batch.column(c).to_pylist() for c in ("k", "last", "chunk"))):
                at, parts = [], []
                for m in find.finditer(text):
                    at.append(m.start())
                    parts.append(ids[m[0]])
                place = np.array(at, np.int64)
                before = np.cumsum([0, *(len(p) // 4 for p in parts[:-1])])[: len(at)]
                sure = place <= (len(text) if last else len(text) - AHEAD)
                lists.append(array("i", b"".join(parts)))
                for here, positions, tokens in ((sure & (place < overlap) & (k > 0), *sides[:2]), (sure & (place >= chunk) & (not last), *sides[2:])):
                    positions.append((k * chunk + place[here]).tolist())
                    tokens.append(before[here].tolist())
            borders = [pa.array(s, pa.list_(pa.int64() if n % 2 == 0 else pa.int32())) for n, s in enumerate(sides)]
            yield pa.RecordBatch.from_arrays([*batch.columns, _id_lists(lists), *borders], names=[*batch.schema.names, "ids", "head", "head_ids", "tail", "tail_ids"])

    return run


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, decoded: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id and ``ids`` (array of int), as the tiktoken library encodes without special tokens.

    With ``decoded`` a column of that name has the bytes of the ids, as ``decode`` adds
    them; a short text's are made by the worker that encodes it, so that its ids do not
    go to a second one beside it.

    Edge cases: a null text counts as empty, an empty text has no ids; null and
    repeated ids are carried through, row by row; further columns are ignored; an empty
    table gives an empty result.
    """
    kind = docs.schema[id_col].dataType
    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("chars", F.length("text"))
    short = given.where(F.col("chars") <= chunk + overlap).select("id", "text")
    out = pa.schema([("id", to_arrow_type(kind)), ("ids", pa.list_(pa.int32())), *([("bytes", pa.binary())] if decoded else [])])
    out_types = f"id {kind.simpleString()}, ids array<int>" + (", bytes binary" if decoded else "")
    whole = short.mapInArrow(_encode_batches(path, pattern, out), out_types)

    # number of chunks: the last one starts before the end, and holds what its overlap would
    count = F.ceil((F.col("chars") - overlap) / chunk).cast("int")
    long_ = given.where(F.col("chars") > chunk + overlap).withColumn("row", F.monotonically_increasing_id())
    chunks = (
        long_.withColumn("n", count)
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .withColumn("last", F.col("k") == F.col("n") - 1)
        .select("id", "row", "k", "last", F.substring("text", F.col("k") * chunk + 1, F.lit(chunk + overlap)).alias("chunk"))
        .repartition("row", "k")
    )
    sides = "head array<long>, head_ids array<int>, tail array<long>, tail_ids array<int>"
    encoded = chunks.mapInArrow(_encode_chunks(path, pattern, chunk, overlap), f"id {kind.simpleString()}, row long, k int, last boolean, chunk string, ids array<int>, {sides}")
    order, all_of = Window.partitionBy("row").orderBy("k"), Window.partitionBy("row")
    stitched = (
        encoded.withColumn("start", F.when(F.col("k") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(order)))))
        .withColumn("end", F.lead("start").over(order))
        .withColumn("apart", F.max(F.col("start").isNull()).over(all_of))
    )
    # the ids of a piece lie between those before its chunk's stitch and those before the next one
    since = F.when(F.col("k") == 0, F.lit(0)).otherwise(F.expr("element_at(head_ids, int(array_position(head, start)))"))
    until = F.when(F.col("last"), F.size("ids")).otherwise(F.expr("element_at(tail_ids, int(array_position(tail, end)))"))
    piece = F.when(~F.col("apart"), F.slice("ids", since + 1, until - since))
    raw = F.when(F.col("apart"), F.when(F.col("last"), F.col("chunk")).otherwise(F.substring("chunk", 1, chunk)))
    # one long text is put together by one task, as its row must be in the end
    joined = stitched.select("id", "row", "k", "apart", piece.alias("ids"), raw.alias("raw")).groupBy("row", "id").agg(F.max("apart").alias("apart"), F.array_sort(F.collect_list(F.struct("k", "ids", "raw"))).alias("parts"))
    stitched_ids = joined.where(~F.col("apart")).select("id", F.flatten(F.col("parts.ids")).alias("ids"))
    unstitched = joined.where("apart").select("id", F.array_join(F.col("parts.raw"), "").alias("text"))
    rest = unstitched.mapInArrow(_encode_batches(path, pattern, out), out_types)
    if decoded:
        stitched_ids = decode(stitched_ids, path)
    found = whole.unionByName(stitched_ids).unionByName(rest)
    return (found.withColumnRenamed("bytes", decoded) if decoded else found).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", as_col: str = "bytes") -> DataFrame:
    """``encoded`` with the bytes of its ids added; null ids give null, no ids give no bytes.

    An id that the ranks lack fails the query.
    """

    @F.arrow_udf("binary")
    def joined(lists: pa.Array) -> pa.Array:
        names, flat = _names(path), np.asarray(lists.flatten())
        out, at = [], 0
        for n in pa.compute.list_value_length(lists).to_pylist():
            out.append(None if n is None else b"".join(names[flat[at : at + n]].tolist()))
            at += n or 0
        return pa.array(out, pa.binary())

    return encoded.withColumn(as_col, joined(F.col(ids_col)))


_NAMES: dict[str, np.ndarray] = {}


def _names(path: str) -> np.ndarray:
    """Bytes by id, loaded once per worker process."""
    if path not in _NAMES:
        ranks = load_ranks(path)
        table = np.full(max(ranks.values()) + 1, None, object)
        for token, i in ranks.items():
            table[i] = token
        _NAMES[path] = table
    return _NAMES[path]
