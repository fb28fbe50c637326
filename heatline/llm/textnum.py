"""Whole-batch text arithmetic on Arrow string buffers.

Word spans and 64-bit word hashes of a batch of texts are computed with numpy
over the raw UTF-8 buffer, so no Python object is made for a word.  Large
batches are taken in pieces of about ``PIECE`` bytes cut between words; memory
is bounded by that and by the longest single word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)

#: Byte classes: 0 separates words, equal non-zero neighbours belong to one word.
SPACE_WORDS = np.ones(256, np.uint8)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = 0

#: Letters (and every byte of a non-ASCII character), digits and other marks apart.
CLASS_WORDS = np.full(256, 3, np.uint8)
CLASS_WORDS[[0x20, *range(0x09, 0x0E)]] = 0
CLASS_WORDS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
CLASS_WORDS[48:58] = 2

LOWER_AZ = np.arange(256, dtype=np.uint8)
LOWER_AZ[65:91] += 32

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _S33)
    h = h * _M1
    h ^= h >> _S33
    h *= _M2
    h ^= h >> _S33
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, PIECE + 1)
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, len(column) + 1, column.offset * 8)
    if data is None or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8, offsets[-1] - offsets[0], offsets[0]), offsets - offsets[0]


def byte_slices(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) of a string column, in slices of about ``limit`` bytes; a longer text comes alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, "right")))
        yield i, column.slice(i, j - i)
        i = j


def spans(buf: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; a word never crosses a row's edge."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind = classes[buf]
    edge = np.empty(len(buf) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    word = kind[cuts[:-1]] != 0
    return cuts[:-1][word], cuts[1:][word]


def _hash_piece(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _power_tables(len(buf) + 1)
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    part = buf.astype(np.uint64)
    part += np.uint64(1)
    part *= up[: len(buf)]
    np.cumsum(part, out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _M2)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, the same wherever the word stands."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + PIECE, "right")))
        out[i:j] = _hash_piece(buf[a : ends[j - 1]], starts[i:j] - a, ends[i:j] - a)
        i = j
    return out


def word_hashes(column, classes: np.ndarray = SPACE_WORDS, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column in order, and the row bounds in them (one more than rows)."""
    buf, offsets = buffers(column)
    if lower:
        buf = LOWER_AZ[buf]
    starts, ends = spans(buf, offsets, classes)
    return span_hashes(buf, starts, ends), np.searchsorted(starts, offsets, "left")


def row_ids(bounds: np.ndarray) -> np.ndarray:
    """For each element the row that holds it."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of every row's values along the first axis; empty rows give 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
