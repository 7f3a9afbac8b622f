"""Vectorised word and shingle hashing over Arrow string columns.

Words are maximal runs of bytes other than space and 0x09-0x0D, which in UTF-8 is the same as
runs of code points matching ``[^\\x20\\x09-\\x0D]+``.  Nothing here loops over characters or words
in Python; every step is a numpy operation over the bytes of a whole batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_ROOT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ROOT) | np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BREAK = _SPACE.copy()  # ASCII punctuation too
_BREAK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and len(buffer) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """The words of a batch of texts: ``hash`` per word, and ``first`` with the first word of each text (n + 1).

    ``terms`` ends words at ASCII punctuation as well.
    """

    def __init__(self, column: pa.Array | pa.ChunkedArray, lower: bool = True, terms: bool = False):
        data, self.offsets = text_bytes(column)
        n = len(self.offsets) - 1
        if lower:
            data = _LOWER[data]
        inside = ~(_BREAK if terms else _SPACE)[data]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        edges = self.offsets[:-1]
        edges = edges[edges < len(data)]
        starts[edges] |= inside[edges]
        self.start = np.flatnonzero(starts)
        self.data, self.inside = data, inside
        self.first = np.searchsorted(self.start, self.offsets)
        if not len(self.start):
            self.hash = np.zeros(0, np.uint64)
            return
        place = np.arange(len(data), dtype=np.int64)
        place -= np.repeat(self.start, np.diff(np.append(self.start, len(data)))) if self.start[0] == 0 else np.concatenate(
            [np.zeros(self.start[0], np.int64), np.repeat(self.start, np.diff(np.append(self.start, len(data))))])
        power = np.empty(int(place.max()) + 1, np.uint64)
        power[0] = 1
        power[1:] = _ROOT
        np.multiply.accumulate(power, out=power)
        part = _BYTE[data]
        part *= power[place]
        part[~inside] = 0
        self.hash = mix(np.add.reduceat(part, self.start))

    def counts(self) -> np.ndarray:
        """The number of words of each text."""
        return np.diff(self.first)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in text order and the first shingle of each text (n + 1).

    A text of 1 to k - 1 words has one shingle, its whole word sequence; a text without words has none.
    """
    h, first = words.hash, words.first
    counts = np.diff(first)
    number = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(number)])
    total = int(begin[-1])
    at = np.arange(total) - np.repeat(begin[:-1], number) + np.repeat(first[:-1], number)
    out = np.zeros(total, np.uint64)
    multiplier = np.uint64(0xD6E8FEB86659FD93)
    short = np.repeat(counts < k, number)
    limit = np.repeat(np.minimum(counts, k), number)
    for j in range(k):
        ok = limit > j
        out[ok] = out[ok] * multiplier + h[at[ok] + j] + np.uint64(j + 1)
    out[short] ^= limit[short].astype(np.uint64)
    return mix(out), begin


def distinct(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values within each segment, and the new segment starts."""
    number = np.diff(begin)
    owner = np.repeat(np.arange(len(number)), number)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(len(number) + 1))
