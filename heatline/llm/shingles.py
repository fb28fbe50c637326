"""Word-shingle sets and MinHash signatures of a batch of texts (numpy, per Arrow batch)."""

from __future__ import annotations

import numpy as np

from . import textnum

_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(column, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every row, and row bounds.

    A-Z is lower-cased; words are runs of bytes other than space and 0x09-0x0D.
    A row with fewer than ``width`` words has its whole sequence as one shingle;
    a row without words has none.
    """
    words, bounds = textnum.word_hashes(column)
    counts = np.diff(bounds)
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(n)])
    if not out_bounds[-1]:
        return np.empty(0, np.uint64), out_bounds
    first = np.repeat(bounds[:-1] - out_bounds[:-1], n) + np.arange(out_bounds[-1])
    size = np.repeat(np.minimum(counts, width), n)
    h = size.astype(np.uint64)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    for k in range(width):
        w = padded[first + k] * (_STEP + np.uint64(2 * k))
        h = textnum.mix(h * _STEP + (w if counts.min(initial=width) >= width else np.where(size > k, w, np.uint64(0))))
    rows = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, rows)) if len(n) > 1 else np.argsort(h)
    h, rows = h[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    kept = np.bincount(rows[new], minlength=len(n))
    return h[new], np.concatenate([[0], np.cumsum(kept)])


def hash_family(size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``size`` members of the multiply-shift universal family on 64 bits."""
    rng = np.random.Generator(np.random.PCG64(seed))
    a = rng.integers(0, 1 << 63, size, np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, size, np.uint64) * np.uint64(2)


def signatures(sets: np.ndarray, bounds: np.ndarray, family, block: int = 1 << 15) -> np.ndarray:
    """The minimum of every hash over each non-empty row's set: (hashes, rows) uint32; empty rows hold the maximum."""
    a, b = family
    out = np.full((len(a), len(bounds) - 1), np.iinfo(np.uint32).max, np.uint32)
    filled = np.flatnonzero(np.diff(bounds))
    i = 0
    while i < len(filled):
        start = bounds[filled[i]]
        j = i + max(1, int(np.searchsorted(bounds[filled[i:] + 1], start + block, "right")))
        rows = filled[i:j]
        x, at = sets[start : bounds[rows[-1] + 1]], bounds[rows] - start
        for k in range(len(a)):
            h = x * a[k]
            h += b[k]
            h >>= np.uint64(32)
            out[k, rows] = np.minimum.reduceat(h, at)
        i = j
    return out


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x))
