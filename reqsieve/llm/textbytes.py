"""Whole texts as byte arrays inside a task: words, their 64-bit hashes, row boundaries.

A word hash is a polynomial over 64-bit values drawn per byte, so that a chunk of many
rows is hashed by a handful of array passes. Two different words meet with a chance of
about 2**-64; nothing here depends on the size of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX_1, _MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the byte values in the closed ranges."""
    member = np.zeros(256, bool)
    for low, high in ranges:
        member[low : high + 1] = True
    return member


#: Letters, digits and everything beyond ASCII.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Everything but white space.
VISIBLE = ~byte_class((0x09, 0x0D), (0x20, 0x20))
#: Everything but the line feed.
LINE = ~byte_class((0x0A, 0x0A))

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values over the whole word."""
    h = h ^ (h >> _SHIFT)
    h = h * _MIX_1
    h = h ^ (h >> _SHIFT)
    h = h * _MIX_2
    return h ^ (h >> _SHIFT)


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    steps = np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)
    return mix(steps * _BASE)


_VALUES = seeded(256, 1)[LOWER]
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, factor: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(kind)
    if known is None or len(known) < n:
        table = np.full(max(n, 1 << 16), factor, np.uint64)
        table[0] = 1
        known = _powers[kind] = np.multiply.accumulate(table)
    return known


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offset of each row; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes, or one longer row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of each chunk of a text column."""
    data, offsets = column_bytes(column)
    for first, last in row_chunks(offsets, limit):
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]


class Words(NamedTuple):
    start: np.ndarray  # byte position of each word
    end: np.ndarray
    bounds: np.ndarray  # rows + 1 positions: which words belong to a row

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = ALNUM) -> Words:
    """Maximal runs of member bytes; a run ends with its row."""
    inside = member[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    filled = offsets[:-1] < offsets[1:]
    before[offsets[:-1][filled]] = False
    after[offsets[1:][filled] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(start, end, np.searchsorted(start, offsets))


def hashes(data: np.ndarray, found: Words, values: np.ndarray = _VALUES) -> np.ndarray:
    """The hash of each word; A-Z and a-z hash alike under the default values."""
    if not len(found.start):
        return np.zeros(0, np.uint64)
    sums = values[data]
    sums *= _power("up", _BASE, len(data))[: len(data)]
    np.cumsum(sums, out=sums)
    total = sums[found.end - 1]
    total[found.start > 0] -= sums[found.start[found.start > 0] - 1]
    return mix(total * _power("down", _INVERSE, len(data))[found.start])


def shingles(word_hash: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` successive words and their rows; a shorter row, if it has words, is one shingle."""
    counts = np.diff(bounds)
    padded = np.concatenate([word_hash, np.zeros(size, np.uint64)])
    code, factor = np.zeros(len(word_hash), np.uint64), np.uint64(1)
    position = np.arange(len(word_hash)) - np.repeat(bounds[:-1], counts)
    length = np.repeat(counts, counts)
    short = length < size
    for j in range(size):
        part = padded[j : j + len(word_hash)] * factor
        if short.any():
            part[position + j >= length] = 0
        code += part
        factor = np.uint64(int(factor) * int(_BASE) & (1 << 64) - 1)
    keep = np.where(short, position == 0, position + size <= length)
    return mix(code[keep]), np.repeat(np.arange(len(counts)), counts)[keep]
