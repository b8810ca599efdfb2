"""Text columns as byte arrays: blocks of bounded size, words, and hashes of words and windows.

A word is ``[^\\x20\\x09-\\x0D]+``. Hashes have 64 bits; equal hashes are taken as equal words, which
within one document of a million words errs with a probability below 1e-7.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 21
MASK = (1 << 64) - 1


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 64-bit integers."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets that part its rows; a null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64, len(column) + 1, column.offset * 8)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    held = np.frombuffer(data, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0]))
    return held, offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows that together have at most ``size`` bytes, or are one longer row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def text_blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, last row, bytes, offsets)`` of each block of a text column."""
    data, offsets = utf8(column)
    for first, last in blocks(offsets, size):
        lo, hi = offsets[first], offsets[last]
        yield first, last, data[lo:hi], offsets[first : last + 1] - lo


def _separators() -> np.ndarray:
    found = np.zeros(256, bool)
    found[[9, 10, 11, 12, 13, 32]] = True
    return found


def _letters(lower: bool) -> np.ndarray:
    values = splitmix(np.arange(256, dtype=np.uint64)) | np.uint64(1)
    if lower:
        values[65:91] = values[97:123]
    return values


def powers(n: int) -> np.ndarray:
    """``1, c, c^2, ...`` modulo 2^64 for an odd ``c``."""
    steps = np.full(max(n, 1), 0xD1342543DE82EF95, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A hash of ``data[start:end]`` for spans in rising order that do not overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    begin = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(begin, lengths)
    flat = within + np.repeat(starts, lengths)
    parts = table[data[flat]] * powers(int(lengths.max()))[within]
    return splitmix(np.add.reduceat(parts, begin) + lengths.astype(np.uint64))


@dataclass
class Words:
    """Words of a block: byte spans, hashes, and ``bounds[i]:bounds[i + 1]`` of document i."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def documents(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of each document of a block; ``lower`` hashes A-Z as a-z."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~_separators()[data]
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    stops = inside[:-1] & ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(
        starts, ends, np.searchsorted(starts, offsets), span_hashes(data, starts, ends, _letters(lower))
    )


def windows(found: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every window of ``n`` words inside one document."""
    total = len(found.hashes)
    if total < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashed = np.zeros(total - n + 1, np.uint64)
    for j, c in enumerate(powers(n + 1)[1:]):
        hashed += found.hashes[j : total - n + 1 + j] * c
    documents = found.documents
    first = np.flatnonzero(documents[: total - n + 1] == documents[n - 1 :])
    return first, splitmix(hashed[first])


@dataclass
class Lines:
    """Lines parted by ``\\n``: byte spans without it, hashes, document of each."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray

    @property
    def documents(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def lines(data: np.ndarray, offsets: np.ndarray) -> Lines:
    """Lines of each document of a block. Every document, also an empty one, has at least one."""
    breaks = np.flatnonzero(data == 10)
    documents = np.searchsorted(offsets, breaks, "right") - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([breaks, offsets[1:]])
    n = len(offsets) - 1
    order = np.lexsort((starts, np.concatenate([np.arange(n), documents])))
    ended = np.lexsort((ends, np.concatenate([documents, np.arange(n)])))
    starts, ends = starts[order], ends[ended]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(documents, minlength=n) + 1)])
    held = np.flatnonzero(ends > starts)
    hashes = np.zeros(len(starts), np.uint64)
    hashes[held] = span_hashes(data, starts[held], ends[held], _letters(False))
    return Lines(starts, ends, bounds, hashes)


def earlier_equal(keys: np.ndarray) -> np.ndarray:
    """Whether an equal key stands before."""
    _, first = np.unique(keys, return_index=True)
    found = np.ones(len(keys), bool)
    found[first] = False
    return found


def found_twice(keys: np.ndarray) -> np.ndarray:
    """Whether a key occurs twice or more."""
    _, place, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[place] > 1
