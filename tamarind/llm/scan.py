"""Vectorised scanning of Arrow text columns inside Spark tasks.

Words are found and hashed on the raw UTF-8 buffers with numpy, so that no
Python string is made per word.  All helpers work on bounded slices of a batch:
a slice holds whole documents and at most ``SLICE_BYTES`` of text, except that
a longer document is a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: ASCII letters A-Z lower-cased, all other bytes kept.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that are cut at the six ASCII white-space characters.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words made of digits, lower-case letters and all non-ASCII characters.
WORD_CHARS = np.zeros(256, bool)
WORD_CHARS[48:58] = WORD_CHARS[97:123] = WORD_CHARS[128:] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of both bases; those of an ordinary slice are kept, longer ones are made for a long text and dropped."""
    if len(_POW[0]) >= n:
        return _POW[0][:n], _POW[1][:n]
    made = []
    for base in (_P, _P_INV):
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps))
    if n <= SLICE_BYTES + 1:
        _POW[:] = made
    return made[0][:n], made[1][:n]


def release() -> None:
    """Gives freed memory back to the system: a reused Python worker would keep the peak of every stage it served."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, which spreads every input bit over the result."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    """Words of a slice: byte ranges in ``data``, 64-bit hashes, and the first word of each document."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # one more entry than there are documents

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of whole documents of about ``most`` bytes."""
    data, offsets = buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, chars: np.ndarray = NOT_SPACE, lower: bool = True, cut: np.ndarray | None = None) -> Words:
    """Cuts each document into runs of the given bytes and hashes them; ``cut`` marks bytes that begin a word of their own."""
    low = LOWER[data] if lower else data
    n = len(low)
    inside = np.zeros(n + 1, bool)
    inside[:n] = chars[low]
    edge = np.zeros(n + 1, bool)  # a word can't continue over the start of a document
    edge[offsets] = True
    if cut is not None:
        edge[:n] |= cut
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge))
    end = np.flatnonzero(before & (~inside | edge))
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[low] * power[:n], out=sums[1:])
    h = (sums[end] - sums[start]) * inverse[start]
    return Words(low, start, end, mix(h ^ ((end - start).astype(np.uint64) << np.uint64(40))), np.searchsorted(start, offsets))


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending, and the first of each document.

    A document with fewer than ``size`` words, but not none, has its whole
    sequence as its only shingle.
    """
    n, counts = len(w.hash), np.diff(w.first)
    h = np.zeros(n, np.uint64)
    mult = np.uint64(0xD6E8FEB86659FD93)
    for k in range(size):  # positions past the document's end are cut off below
        part = np.zeros(n, np.uint64)
        part[: n - k] = w.hash[k:] if k else w.hash
        h = mix(h * mult + part + np.uint64(k + 1))
    doc = w.doc
    left = w.first[1:][doc] - np.arange(n)  # words up to the end of the document
    keep = left >= size
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        at, x = w.first[:-1][short], counts[short].astype(np.uint64)
        for k in range(size - 1):
            more = counts[short] > k
            x[more] = mix(x[more] * mult + w.hash[at[more] + k] + np.uint64(k + 1))
        h[at] = x
        keep[at] = True
    h, doc = h[keep], doc[keep]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(counts) + 1))
