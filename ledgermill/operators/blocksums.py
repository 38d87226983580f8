"""Blocks of postings, and the best documents of each request over them, worked out where the blocks lie.

A task adds up a block at a time, as a table of requests and documents, and keeps of each
request the ``k`` best it has met.  So no sum is dealt: a task sends ``k`` rows a request.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Sums of requests and documents, and postings of requests, that a task holds at once.
CELLS, PAIRS = 4_000_000, 2_000_000
#: Scores are rounded to six places afterwards; what is closer to the k-th best stays until then.
SLACK = 2e-6


def _lists(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Lengths of lists, 0 for a missing one, and their elements in a row."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return lengths.astype(np.int64), column.flatten()


def _values(elements: pa.StructArray, *names: str) -> list[np.ndarray]:
    return [elements.field(n).to_numpy(zero_copy_only=False) for n in names]


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Place of each row in its run of equal neighbours, from 0."""
    n = len(columns[0])
    new = np.ones(n, dtype=bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    starts = np.flatnonzero(new)
    return np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))


def _codes(column: np.ndarray) -> np.ndarray:
    return np.unique(column, return_inverse=True)[1] if column.dtype == object else column


def filed(docs: pa.Table, schema: pa.Schema) -> pa.Table:
    """The postings of a block's documents (block, segment, id, copies, words): a row a token, in order, its documents in theirs; see ``schema``."""
    docs = docs.combine_chunks()
    n = docs.num_rows
    lengths, words = _lists(docs["words"].combine_chunks())
    known = words.dictionary_encode()
    order = pc.sort_indices(known.dictionary).to_numpy()
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    cells, tf = np.unique(place[known.indices.to_numpy()] * n + np.repeat(np.arange(n), lengths), return_counts=True)
    token, doc = cells // n, cells % n
    of, copies = schema.field("postings").type.value_type, docs["copies"].to_numpy()
    columns = {"id": docs["id"].combine_chunks().take(pa.array(doc)), "tf": tf, "dl": lengths[doc], "size": np.bincount(doc, minlength=n)[doc]}
    postings = pa.StructArray.from_arrays([pa.array(columns[f.name], f.type) for f in of], fields=list(of))
    ends = np.searchsorted(token, np.arange(len(order) + 1))
    rows = {
        "token": known.dictionary.take(pa.array(order)),
        "block": np.full(len(order), docs["block"][0].as_py()),
        "postings": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), postings, type=schema.field("postings").type),
        "df": np.diff(np.append(0, np.cumsum(copies[doc]))[ends]),
        "segment": np.full(len(order), docs["segment"][0].as_py()),
        "starts": np.arange(len(order)) == 0,
        "ends": np.arange(len(order)) == len(order) - 1,
    }
    return pa.Table.from_arrays([c if isinstance(c := rows[f.name], pa.Array) else pa.array(c, f.type) for f in schema], schema=schema)


class _Best:
    """Of each request the k best sums so far, those within the slack of the k-th, and of equal ones the k smallest ids."""

    def __init__(self, k: int, patience: int):
        self.k, self.patience = k, patience
        self.held: list[np.ndarray] | None = None
        self.new: list[list[np.ndarray]] = []
        self.count = 0
        self.full, self.kth = np.array([]), np.array([])

    def least(self, qids: np.ndarray) -> np.ndarray:
        """The sums that these requests' documents must reach; above 0 in any case."""
        if not len(self.full):
            return np.zeros(len(qids))
        at = np.minimum(np.searchsorted(self.full, qids), len(self.full) - 1)
        return np.where(self.full[at] == qids, np.maximum(self.kth[at] - SLACK, 0.0), 0.0)

    def add(self, *columns: np.ndarray) -> None:
        """(qid, id, value, part, asked, size)"""
        self.new.append(list(columns))
        self.count += len(columns[0])
        if self.count > max(self.patience, len(self.held[0]) if self.held else 0):
            self.weigh()

    def weigh(self) -> None:
        if not self.new:
            return
        rows = [np.concatenate(c) for c in zip(*([self.held] if self.held else []), *self.new)]
        qid, value = _codes(rows[0]), rows[2]
        order = np.lexsort((_codes(rows[1]), -value, qid))
        rows, qid, value = [c[order] for c in rows], qid[order], value[order]
        place = _runs(qid)
        last = place == self.k - 1
        self.full, self.kth = rows[0][last], value[last]
        keep = (place < self.k) | ((value >= self.least(rows[0])) & (_runs(qid, value) < self.k))
        self.held, self.new, self.count = [c[keep] for c in rows], [], 0


def _sums(block: dict, gain: Callable, step: Callable) -> None:
    """Hands ``step`` the sums of a block, (qids, ids, parts by request and document, asked, sizes), some requests at a time."""
    lengths, n_asked = np.concatenate(block["lengths"]), np.concatenate(block["n_asked"])
    ids, tf, dl, size = (np.concatenate(c) for c in zip(*block["postings"]))
    qids, w, asked = (np.concatenate(c) for c in zip(*block["asked"]))
    if not len(ids) or not len(qids):
        return
    live = None
    if block["gone"] is not None and len(block["gone"]):
        live = ~np.isin(ids, block["gone"])
    docs, first, doc = np.unique(ids, return_index=True, return_inverse=True)
    gains = np.broadcast_to(gain(tf.astype(np.float64), dl.astype(np.float64)), tf.shape)
    if live is not None:
        gains = np.where(live, gains, 0.0)
    starts = np.cumsum(lengths) - lengths
    row = np.repeat(np.arange(len(lengths)), n_asked)
    who, first_of, which = np.unique(qids, return_index=True, return_inverse=True)
    order = np.argsort(which, kind="stable")  # tokens of a request stay in their order, so that equal documents have equal sums
    row, w, which = row[order], w[order], which[order]
    pairs = np.concatenate([[0], np.cumsum(lengths[row])])
    ends = np.searchsorted(which, np.arange(len(who) + 1))  # entries of each request
    begin, most = 0, max(CELLS // len(docs), 1)
    while begin < len(who):
        end = int(np.searchsorted(pairs[ends], pairs[ends[begin]] + PAIRS, side="right")) - 1
        end = min(max(end, begin + 1), begin + most, len(who))
        e = slice(ends[begin], ends[end])
        n = lengths[row[e]]
        at = np.repeat(starts[row[e]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cells = np.repeat(which[e] - begin, n) * len(docs) + doc[at]
        parts = np.bincount(cells, np.repeat(w[e], n) * gains[at], (end - begin) * len(docs)).reshape(-1, len(docs))
        step(who[begin:end], docs, parts, asked[first_of[begin:end]], size[first])
        begin = end


def best_of_blocks(batches: Iterator[pa.RecordBatch], schema: pa.Schema, k: int, gain: Callable, value: Callable, patience: int) -> Iterator[pa.RecordBatch]:
    """(qid, id, part, asked, size) of rows (segment, block, split, starts, ends, postings, requests, gone), a row a token, a block's rows together.

    ``postings``: (id, tf, dl, size); ``requests``: (qid, w, asked) of those with the token;
    ``gone``: ids that do not count.  A part is the sum of w * gain(tf, dl); the best are
    those of the largest value(part, asked, size).  A block that begins or ends in another
    task, with no row that starts or ends it, gives all its sums, to be added up.
    """
    best, out = _Best(k, patience), []

    def whole(qids, docs, parts, asked, size):
        values = value(parts, asked[:, None], size[None, :])
        q, d = np.nonzero((parts != 0) & (values > 0) & (values >= best.least(qids)[:, None]))
        best.add(qids[q], docs[d], values[q, d], parts[q, d], asked[q], size[d])

    def broken(qids, docs, parts, asked, size):
        q, d = np.nonzero(parts)
        out.append((qids[q], docs[d], parts[q, d], asked[q], size[d]))

    def batch_of(columns):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    block = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("segment", "block", "split")]
        cuts = np.append(np.flatnonzero(_runs(*keys) == 0), batch.num_rows)
        for a, b in zip(cuts[:-1], cuts[1:]):
            key = tuple(int(c[a]) for c in keys)
            if block is not None and block["key"] != key:
                _sums(block, gain, whole if block["starts"] and block["ends"] else broken)
                block = None
            part = batch.slice(a, b - a)
            if block is None:
                gone = part.column("gone")[0]
                block = {"key": key, "starts": False, "ends": False, "gone": gone.values.to_numpy(zero_copy_only=False) if gone.is_valid else None, "lengths": [], "n_asked": [], "postings": [], "asked": []}
            lengths, postings = _lists(part.column("postings"))
            n_asked, asked = _lists(part.column("requests"))
            block["lengths"].append(lengths)
            block["n_asked"].append(n_asked)
            block["postings"].append(_values(postings, "id", "tf", "dl", "size"))
            block["asked"].append(_values(asked, "qid", "w", "asked"))
            block["starts"] |= pc.any(part.column("starts")).as_py()
            block["ends"] |= pc.any(part.column("ends")).as_py()
        while out:
            yield batch_of(out.pop())
    if block is not None:
        _sums(block, gain, whole if block["starts"] and block["ends"] else broken)
    best.weigh()
    yield from (batch_of(c) for c in out)
    if best.held:
        yield batch_of([best.held[i] for i in (0, 1, 3, 4, 5)])
