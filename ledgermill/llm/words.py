"""Vectorised word and shingle fingerprints for Arrow batches.

A word is a maximal run of bytes outside ``0x20`` and ``0x09-0x0D``.  All six
separators are single UTF-8 bytes, so words can be found and hashed on the raw
UTF-8 buffer of a whole batch with numpy, without creating Python strings.

The fingerprint of a word is a polynomial over the ring of 64-bit integers whose
coefficients are random table entries, one per byte value; a run of words is
fingerprinted by a random linear form of its (finalised) word fingerprints.
Seeds are fixed, so every executor and every rerun computes the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_ROOT = int(_RNG.integers(1, 2**62)) * 4 + 1
_ROOT_INVERSE = pow(_ROOT, -1, 2**64)
_FORM = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes of text that are fingerprinted at a time; bounds the memory of a task.
SLICE_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * _U(pow(base, done, 2**64))
        done += step
    return out


class _Powers:
    """Grown on demand and kept by the worker process."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_ROOT, n), _powers(_ROOT_INVERSE, n)
        return cls.up, cls.down


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words of the documents ``raw[starts[i]:ends[i]]``.

    Returns (fingerprint of each word, number of words of each document).
    Documents must be adjacent and in order.
    """
    base, last = (int(starts[0]), int(ends[-1])) if len(starts) else (0, 0)
    data = raw[base:last]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    word = ~_SPACE[data]
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1]
    closes[:-1] &= ~word[1:]
    edge = (starts - base)[(starts < ends)]
    opens[edge] = word[edge]  # a word never runs across documents
    edge = (ends - base)[(starts < ends)] - 1
    closes[edge] = word[edge]
    first, past = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    up, down = _Powers.reach(len(data) + 1)
    table = _BYTE[_LOWER] if lower else _BYTE
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=total[1:])
    found = mix((total[past] - total[first]) * down[first] + (past - first).astype(np.uint64))
    counts = np.searchsorted(first, ends - base) - np.searchsorted(first, starts - base)
    return found, counts.astype(np.int64)


def windows(words: np.ndarray, size: int, form: int = 0) -> np.ndarray:
    """Fingerprints of the runs of ``size`` words that start at each word (shorter by size - 1).

    Another ``form`` (an offset into the coefficients) gives independent fingerprints.
    """
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out += words[j : j + n] * _FORM[form + j]
    return mix(out)


def text_column(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of the n + 1 borders) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes together; a longer one stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)
