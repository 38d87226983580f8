"""Phrases whose words keep company, by hierarchical naming of neighbouring pairs.

Documents of a language are put together in blocks; a block is a sequence of numbers,
at first one for each distinct word it holds.  A level joins two neighbouring names
into one: the block lists its distinct pairs of neighbours with their counts, a list
for each left name; the lists of all blocks meet by left name, are added up, and pairs
that are frequent enough get an id of their own, which goes back to the blocks that
hold them.  The lists of a very frequent name are dealt in parts.  In the block the pair's
id stands where its first name stood, everything else becomes a gap.  So level k
names the frequent phrases of k words: the pair of the (k-1)-word phrases that start
at a word and at the next one.  Only what is frequent at one level can be part of
something frequent at the next.

The two ids of a pair are pointers to its parents, the phrase without its last and
without its first word.  Along them a phrase inherits the frequencies of all its
beginnings and endings, which its cuts need, and hands its own frequency to the two
phrases that it might subsume.

Blocks are written into buckets by their number, so the sequences are never shuffled;
what is shuffled are a block's distinct pairs, not its occurrences.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.llm.buckets import Buckets
from ledgermill.llm.shared import stored
from ledgermill.llm.words import _LOWER, slices, text_column

#: Bytes of text in a block, unless a single document is longer.
BLOCK_BYTES = 6 << 20

_CUTS = np.zeros(256, bool)
_CUTS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAPS = _CUTS.copy()
_GAPS[[0x20, 0x09]] = True

_WORDS = "block long, lang string, seq array<int>, words array<string>, counts array<long>"
_PAIRS = "block long, left long, part int, start int, rights binary, counts binary"
_NAMED = "block long, numbers array<int>, ids array<long>, parts array<int>, id long, left long, right long, f long"

#: Occurrences of a name that one task adds up; the pairs that begin with a more frequent one are dealt in parts.
PART_OCCURRENCES = 4_000_000
#: Pairs that are added up together.
TURN_PAIRS = 1_000_000


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(words of the documents ``raw[offsets[i]:offsets[i + 1]]``, whether a piece starts with the word)."""
    data = _LOWER[raw[offsets[0] : offsets[-1]]]
    starts = offsets[:-1] - offsets[0]
    starts = starts[starts < len(data)]
    word = ~_GAPS[data]
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1]
    closes[:-1] &= ~word[1:]
    opens[starts] = word[starts]  # a word never runs across documents
    ends = starts[starts > 0] - 1
    closes[ends] = word[ends]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    border = _CUTS[data].astype(np.int32)
    border[starts] += 1
    border = np.cumsum(border, dtype=np.int32)
    fresh = np.ones(len(first), bool)
    fresh[1:] = border[first[1:]] != border[last[:-1]]
    lengths = np.zeros(len(first) + 1, np.int64)
    np.cumsum(last - first + 1, out=lengths[1:])
    column = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(lengths), pa.py_buffer(data[word]))
    return column.dictionary_encode(), fresh


def _blocks(block_bytes: int):
    """Per batch of (lang, text): rows of ``_WORDS``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                raw, offsets = text_column(batch.column(1).filter(pa.array(np.asarray(langs.indices) == code)))
                for lo, hi in slices(offsets, block_bytes):
                    if offsets[hi] == offsets[lo]:
                        continue
                    found, fresh = words_of(raw, offsets[lo : hi + 1])
                    if not len(found):
                        continue
                    counts = np.bincount(np.asarray(found.indices), minlength=len(found.dictionary))
                    order = np.argsort(-counts, kind="stable")  # frequent words have small numbers, which compress
                    place = np.empty(len(order), np.int32)
                    place[order] = np.arange(len(order))
                    seq = np.insert(place[np.asarray(found.indices)], np.flatnonzero(fresh), -1)
                    yield _row(number, lang, seq, found.dictionary.cast(pa.string()).take(pa.array(order)), counts[order])
                    number += 1

    return run


def _list(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _batch(schema: dict[str, pa.DataType], rows: int, **columns: pa.Array) -> pa.RecordBatch:
    """Columns not given are null."""
    return pa.RecordBatch.from_arrays([columns[n].cast(t) if n in columns else pa.nulls(rows, t) for n, t in schema.items()], names=list(schema))


_LISTS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _kinds(schema: str) -> dict[str, pa.DataType]:
    pairs = (c.split() for c in schema.split(", "))
    return {n: pa.list_(_LISTS[t[6:-1]]) if t.startswith("array") else _LISTS[t] for n, t in pairs}


def _row(block: int, lang: str, seq: np.ndarray, words: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    one = lambda a: _list(a, np.array([len(a)]), None)
    return _batch(_kinds(_WORDS), 1, block=pa.array([block]), lang=pa.array([lang]), seq=one(seq), words=one(words), counts=one(counts))


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, number of bytes of each value): seven bits a byte, low ones first, all but the last byte marked."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1 << 7 * k)
    starts = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        some = size > k
        out[starts[some] + k] = ((v[some] >> np.uint64(7 * k)) & np.uint64(127)) | np.where(size[some] > k + 1, np.uint64(128), np.uint64(0))
    return out, size


def from_varints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, place of the first byte of each)."""
    last = np.flatnonzero(data < 128)
    starts = np.r_[0, last[:-1] + 1] if len(last) else np.zeros(0, np.int64)
    at = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    bits = (data & 127).astype(np.uint64) << (np.uint64(7) * at.astype(np.uint64))
    return (np.add.reduceat(bits, starts) if len(starts) else bits).astype(np.int64), starts


def _binary(data: np.ndarray, borders: np.ndarray) -> pa.BinaryArray:
    return pa.BinaryArray.from_buffers(pa.binary(), len(borders) - 1, [None, pa.py_buffer(borders.astype(np.int32)), pa.py_buffer(data)])


def _bytes(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, their borders) of all values together."""
    borders = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[borders[0] : borders[-1]], borders - borders[0]


def neighbours(seq: np.ndarray, numbers: np.ndarray, ids: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(sequence of pair numbers; left id, part, right id and count of each pair) of names next to each other.

    ``seq`` holds local numbers and -1 in gaps; ``ids[i]`` is the global name of the
    local number ``numbers[i]``, numbers without a name are gaps.  Pairs are numbered in
    order of their left name, of the part of the right one (the left name has
    ``parts[i]`` of them) and of the right id.
    """
    lookup = np.full(int(max(seq.max(initial=-1), numbers.max(initial=-1))) + 2, -1, np.int64)
    lookup[numbers] = np.arange(len(ids))
    named = lookup[seq]  # -1 looks up the last place, which no number has
    both = (named[:-1] >= 0) & (named[1:] >= 0)
    wide = max(len(ids), 1)
    pairs, at, counts = np.unique(named[:-1][both] * wide + named[1:][both], return_inverse=True, return_counts=True)
    left, right = pairs // wide, pairs % wide
    part = (ids[right] % parts[left]).astype(np.int32)
    order = np.lexsort((ids[right], part, ids[left]))
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    out = np.full(len(both), -1, np.int32)
    out[both] = place[at]
    return out, ids[left[order]], part[order], ids[right[order]], counts[order]


def _join_names(level: int):
    """One block (block, seq of words) and its names (block, level, numbers, ids, parts) of all levels below: a row for each left name and part.

    The sequence of a level follows from the words and the names, so none is stored.
    """
    kinds = _kinds(_PAIRS)
    schema = pa.schema(list(kinds.items()))

    def join(held: pa.Table, names: pa.Table) -> pa.Table:
        if not held.num_rows or not names.num_rows:
            return schema.empty_table()
        seq = np.asarray(held.column("seq").combine_chunks().flatten())
        for below in range(1, level):
            mine = names.filter(pa.compute.equal(names.column("level"), below))
            if not mine.num_rows:
                return schema.empty_table()
            flat = lambda c: np.asarray(mine.column(c).combine_chunks().flatten())  # noqa: B023, E731
            seq, left, part, right, counts = neighbours(seq, flat("numbers"), flat("ids"), flat("parts"))
        if not len(left):
            return schema.empty_table()
        first = np.flatnonzero(np.r_[True, (left[1:] != left[:-1]) | (part[1:] != part[:-1])])
        steps = np.diff(right, prepend=0)
        steps[first] = right[first]
        columns = {}
        for name, values in (("rights", steps), ("counts", counts)):
            data, size = varints(values)
            columns[name] = _binary(data, np.append((np.cumsum(size) - size)[first], len(data)))
        block = np.full(len(first), held["block"][0].as_py())
        return pa.Table.from_batches([_batch(kinds, len(first), block=pa.array(block), left=pa.array(left[first]), part=pa.array(part[first]), start=pa.array(first, pa.int32()), **columns)], schema)

    return join


def _name_pairs(at_least: int, places: bool, turn_pairs: int, part_occurrences: int):
    """Batches of (block, left, part, start, rights, counts) in order of (left, part): rows of ``_NAMED``.

    Each frequent pair gets the next id of the task, with its parents and its count, and
    with ``places`` each row of input gets the ids of its frequent pairs.
    """
    kinds = _kinds(_NAMED)

    def add_up(held: pa.Table, first_id: int) -> Iterator[pa.RecordBatch]:
        block, left, part, start = (np.asarray(held.column(c)) for c in ("block", "left", "part", "start"))
        (steps, begins), borders = from_varints(_bytes(held.column("rights").combine_chunks())[0]), _bytes(held.column("rights").combine_chunks())[1]
        n, _ = from_varints(_bytes(held.column("counts").combine_chunks())[0])
        rows_begin = np.searchsorted(begins, borders)
        lengths = np.diff(rows_begin)
        total = np.cumsum(steps)
        right = total - np.repeat(total[rows_begin[:-1]] - steps[rows_begin[:-1]], lengths)  # steps count from 0 in each row
        run = np.cumsum(np.r_[0, (left[1:] != left[:-1]) | (part[1:] != part[:-1])])
        of_row = np.repeat(np.arange(len(left)), lengths)
        order = np.lexsort((right, run[of_row]))
        r, g = right[order], run[of_row][order]
        first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (g[1:] != g[:-1])])
        total = np.add.reduceat(n[order].astype(np.int64), first)
        frequent = total >= at_least
        ids = np.where(frequent, first_id + np.cumsum(frequent) - 1, -1)
        kept = first[frequent]
        yield _batch(kinds, len(kept), id=pa.array(ids[frequent]), left=pa.array(left[of_row[order[kept]]]), right=pa.array(r[kept]), f=pa.array(total[frequent]))
        if places:
            mine, parts = np.empty(len(right), np.int64), np.empty(len(right), np.int32)
            each = np.diff(np.append(first, len(r)))
            mine[order] = np.repeat(ids, each)
            parts[order] = np.repeat(total // part_occurrences + 1, each)
            starts = np.cumsum(lengths) - lengths
            number = np.repeat(start, lengths) + np.arange(len(right)) - np.repeat(starts, lengths)
            named = mine >= 0
            held_by = np.bincount(of_row[named], minlength=len(left))
            rows = held_by > 0
            some = held_by[rows]
            yield _batch(kinds, len(some), block=pa.array(block[rows]), numbers=_list(number[named], some, pa.int32()), ids=_list(mine[named], some, pa.int64()), parts=_list(parts[named], some, pa.int32()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id, waiting, pairs = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            pairs += len(_bytes(batch.column(batch.schema.names.index("counts")))[0])  # a byte a pair, at least
            if pairs >= turn_pairs:
                held = pa.Table.from_batches(waiting)
                left, part = np.asarray(held.column("left")), np.asarray(held.column("part"))
                border = np.flatnonzero((left[1:] != left[:-1]) | (part[1:] != part[:-1]))
                if len(border):  # the last run may go on in the next batch
                    end = int(border[-1]) + 1
                    for out in add_up(held.slice(0, end).combine_chunks(), next_id):
                        next_id += out.num_rows - out.column(4).null_count
                        yield out
                    waiting = held.slice(end).to_batches()
                    pairs = sum(len(_bytes(b.column(b.schema.names.index("counts")))[0]) for b in waiting)
        if waiting:
            yield from add_up(pa.Table.from_batches(waiting).combine_chunks(), next_id)

    return run


def phrase_table(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 4, at_least: int = 30, block_bytes: int = BLOCK_BYTES) -> tuple[list[DataFrame], DataFrame]:
    """([frequent phrases of 1, 2, ... ``longest`` words], words per language).

    The former have (id, lang, phrase, f, firsts, lasts, left, right): ``firsts[j]`` is the
    frequency of the first j + 1 words, ``lasts[j]`` that of the last; ``left`` and
    ``right`` are the ids of the parents.  The latter has (lang, n), rare words counted.
    """
    spark = docs.sparkSession
    tables = Buckets(spark, int(spark.conf.get("spark.sql.shuffle.partitions")), "block")
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    blocks, plain = tables.write(texts.mapInArrow(_blocks(block_bytes), _WORDS), "words")
    held = plain.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("number", "w")).select("block", "lang", "number", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    total = held.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = held.groupBy("lang", F.col("word").alias("phrase")).agg(F.sum("n").alias("f")).where(F.col("f") >= at_least)
    none = F.lit(None).cast("long")
    levels = [stored(frequent.select(F.monotonically_increasing_id().alias("id"), "lang", "phrase", "f", F.array("f").alias("firsts"), F.array("f").alias("lasts"), none.alias("left"), none.alias("right")), "phrases")]
    one = lambda c: F.array(c).alias(f"{c}s")
    known = levels[0].select("lang", F.col("phrase").alias("word"), "id", ((F.col("f") / PART_OCCURRENCES).cast("int") + 1).alias("part"))
    names = held.join(known, ["lang", "word"]).select("block", F.lit(1).alias("level"), one("number"), one("id"), one("part"))
    for words in range(2, longest + 1):
        joined = blocks.select("block", "seq").groupBy("block").cogroup(names.groupBy("block")).applyInArrow(_join_names(words), _PAIRS)
        dealt = joined.repartition("left", "part").sortWithinPartitions("left", "part")
        named = stored(dealt.mapInArrow(_name_pairs(at_least, words < longest, TURN_PAIRS, PART_OCCURRENCES), _NAMED), "names")
        names = names.union(named.where("block is not null").select("block", F.lit(words), "numbers", "ids", "parts"))
        parents = levels[-1]
        first = parents.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("begin"), "firsts")
        last = parents.select(F.col("id").alias("right"), F.substring_index("phrase", " ", -1).alias("end"), "lasts")
        whole = named.where("id is not null").select("id", "left", "right", "f").join(first, "left").join(last, "right")
        levels.append(stored(whole.select("id", "lang", F.concat_ws(" ", "begin", "end").alias("phrase"), "f", F.concat("firsts", F.array("f")).alias("firsts"), F.concat("lasts", F.array("f")).alias("lasts"), "left", "right"), "phrases"))
    tables.close()
    return levels, total


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 4, at_least: int = 30, best: int = 2000, scale: int = 2_000_000, share: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, words): per language the ``best`` phrases of 2 to ``longest`` words.

    Texts have A-Z lower-cased and are split at ``. , ; : ! ?`` and line ends (0x0A-0x0D)
    into pieces, those at blanks and tabs into words.  ``a`` counts a phrase's contiguous
    occurrences within pieces, overlaps included.  A cut into two parts that occur l and r
    times scores floor(scale * a / (l + r)); the lowest cut counts, of equal ones the
    earliest.  A phrase goes if a longer one holds its words and occurs at least
    ``share`` percent as often.  Order: score, a, then the phrase by its bytes.

    Null and empty texts have no words; a null language is ``und``.  Repeated rows count
    each time.  An empty table gives no row; further columns take no part.
    """
    levels, total = phrase_table(docs, lang_col, text_col, longest, at_least)
    found = None
    big = "CAST({} AS DECIMAL(38, 0))".format
    for words in range(2, longest + 1):
        cuts = F.transform(
            F.sequence(F.lit(1), F.lit(words - 1)),
            lambda k: F.struct(k.alias("k"), F.get("firsts", k - 1).alias("l"), F.get("lasts", F.lit(words - 1) - k).alias("r")),
        )
        phrases = levels[words - 1].withColumn("cuts", cuts)
        scored = phrases.withColumn("cut", F.expr(f"array_min(transform(cuts, c -> struct(CAST({scale} AS DECIMAL(15, 0)) * CAST(f AS DECIMAL(19, 0)) div ({big('c.l')} + c.r) AS score, c.k AS k, c.l AS l, c.r AS r)))"))
        if words < longest:
            longer = levels[words]
            above = longer.select(F.col("left").alias("id"), "f").union(longer.select("right", "f")).groupBy("id").agg(F.max("f").alias("longer"))
            # a phrase of two more words occurs no more often than one of those between
            scored = scored.join(above, "id", "left").where(F.coalesce(F.expr(f"CAST(100 AS DECIMAL(3, 0)) * CAST(longer AS DECIMAL(19, 0)) < CAST({share} AS DECIMAL(3, 0)) * CAST(f AS DECIMAL(19, 0))"), F.lit(True)))
        part = scored.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score", F.lit(words).alias("words"))
        found = part if found is None else found.union(part)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    first = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return first.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "words")
