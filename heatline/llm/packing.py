"""Packing by minimum bin slack.

Every task packs the documents of its own input split in blocks of bounded size,
so packing needs no shuffle and no driver state.  A document's ids beyond whole
windows of its own leave one remainder.  For each window, a subset-sum dynamic
program over the multiset of remaining lengths (one bitset, Python integers,
counts in binary) finds the multiset whose sum comes closest to the capacity;
backtracking through the saved bitsets gives how many of each length it takes,
and the pattern is used as often as the counts allow.  If the closest multiset
leaves slack, one remaining document is cut to close it.  What is left in the
end, less than one window, is cut at powers of two, so no sequence is padded.

Null and empty texts are documents of the end token alone.  Repeated rows are
packed each for itself.  A text of more than one block is a block of its own.  An
empty table gives no pieces.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables, tokens

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Ids packed together: bounds a task's memory, and what one cut remainder can cost.
BLOCK_TOKENS = 2_000_000
_BATCH_BYTES = 4 << 20


def closest_multiset(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Of the multisets within ``counts`` (length -> how many), one with the largest sum up to ``capacity``.

    Lengths join the bitset from the longest down, so that short ones stay for
    later windows; the search ends as soon as the capacity itself is reached.
    """
    mask = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, times = min(counts[length], capacity // length), 1
        while left > 0:
            times = min(times, left)
            steps.append((length, times, reach))
            reach |= (reach << (length * times)) & mask
            left -= times
            times *= 2
            if reach >> capacity:
                break
        if reach >> capacity:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + times
            total -= length * times
    return taken


def fill_windows(remainders: list[tuple[int, int, int]], capacity: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of (document, start, length) from pieces shorter than ``capacity``; each id in one window."""
    by_length: dict[int, list[tuple[int, int]]] = {}
    for doc, start, length in remainders:
        by_length.setdefault(length, []).append((doc, start))
    counts = {k: len(v) for k, v in by_length.items()}
    total = sum(length for _, _, length in remainders)

    def take(length: int) -> tuple[int, int, int]:
        doc, start = by_length[length].pop()
        counts[length] -= 1
        if not counts[length]:
            del counts[length], by_length[length]
        return doc, start, length

    def put(doc: int, start: int, length: int) -> None:
        by_length.setdefault(length, []).append((doc, start))
        counts[length] = counts.get(length, 0) + 1

    while total >= capacity:
        pattern = closest_multiset(counts, capacity)
        slack = capacity - sum(k * n for k, n in pattern.items())
        for _ in range(1 if slack else min(counts[k] // n for k, n in pattern.items())):
            window = [take(k) for k, n in pattern.items() for _ in range(n)]
            if slack:
                doc, start, length = take(min(x for x in counts if x > slack))
                window.append((doc, start, slack))
                put(doc, start + slack, length - slack)
            total -= capacity
            yield window
    rest = [take(k) for k in sorted(counts, reverse=True) for _ in range(counts[k])]
    for size in (1 << k for k in range(capacity.bit_length(), -1, -1)):
        if total & size:
            window, room = [], size
            while room:
                doc, start, length = rest.pop()
                part = min(length, room)
                window.append((doc, start, part))
                room -= part
                if length > part:
                    rest.append((doc, start + part, length - part))
            yield window


def pack_block(lengths: np.ndarray, capacity: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of (document, start, length) for documents of these lengths."""
    remainders = []
    for doc, length in enumerate(lengths.tolist()):
        whole = length - length % capacity
        for start in range(0, whole, capacity):
            yield [(doc, start, capacity)]
        if length > whole:
            remainders.append((doc, whole, length - whole))
    yield from fill_windows(remainders, capacity)


def _blocks(batches: Iterator[pa.RecordBatch], path: str, end: int | None, block_tokens: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Keys, token counts and all ids of successive documents, of ``block_tokens`` ids or a little more; documents without ids are left out."""
    keys, counts, ids = [], [], []
    for held in tables.gathered(batches, tokens.GROUP_BYTES):
        together = pa.Table.from_batches(held).combine_chunks()
        key, (n, flat) = together.column(0).combine_chunks(), tokens.encode_column(together.column(1), path, True, end)
        at = 0
        while at < len(n):
            room = block_tokens - sum(map(len, ids))
            upto = np.searchsorted(np.cumsum(n[at:]), room, "left") + 1 + at
            size = int(n[at:upto].sum())
            keys.append(key.slice(at, upto - at).filter(pa.array(n[at:upto] > 0)))
            counts.append(n[at:upto][n[at:upto] > 0])
            ids.append(flat[:size])
            flat, at = flat[size:], upto
            if size >= room:
                yield pa.concat_arrays(keys), np.concatenate(counts), np.concatenate(ids)
                keys, counts, ids = [], [], []
    if keys:
        yield pa.concat_arrays(keys), np.concatenate(counts), np.concatenate(ids)


def _piece_batch(keys: pa.Array, counts: np.ndarray, first: np.ndarray, ids: np.ndarray, sequences: list[int], pieces: list[tuple[int, int, int]]) -> pa.RecordBatch:
    """The rows of pieces that stand one after the other in whole sequences."""
    doc, start, length = np.array(pieces, np.int64).T
    sequence = np.array(sequences, np.int64)
    ends = np.cumsum(length)
    new = np.append(True, sequence[1:] != sequence[:-1])
    offset = ends - length - (ends - length)[np.flatnonzero(new)][np.cumsum(new) - 1]
    own = ids[tokens.ragged(first[doc] + start, length)].astype("<u4")
    binary = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(np.append(0, 4 * ends).astype(np.int32)), pa.py_buffer(own)])
    columns = [keys.take(pa.array(doc)), *map(pa.array, (start, length, counts[doc], sequence, offset)), binary]
    return pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in SCHEMA.split(", ")])


def pack(
    df: DataFrame, path: str, *, text: str = "text", doc_id: str = "doc_id", capacity: int = 4096, end: int | None = 2, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """Pieces of all documents of ``df`` in sequences of ``capacity`` ids of the vocabulary at ``path``.

    A piece holds ``length`` ids of its document from ``start``, standing at ``offset`` of
    sequence ``sequence_id``; ``ids`` has them as little-endian unsigned 32-bit numbers.
    Sequences are full, but for at most one of each smaller power of two a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 40
        for keys, counts, ids in _blocks(batches, path, end, block_tokens):
            first = np.cumsum(counts) - counts
            window: list[int] = []
            pieces: list[tuple[int, int, int]] = []
            filled = 0
            for own in pack_block(counts, capacity):
                window += [sequence] * len(own)
                pieces += own
                filled += sum(length for _, _, length in own)
                sequence += 1
                if 4 * filled >= _BATCH_BYTES:
                    yield _piece_batch(keys, counts, first, ids, window, pieces)
                    window, pieces, filled = [], [], 0
            if pieces:
                yield _piece_batch(keys, counts, first, ids, window, pieces)
        tokens.give_back()

    return tables.small_batches(df).select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, SCHEMA)
