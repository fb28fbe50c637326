"""Target-distribution importance resampling over hashed word n-grams.

Features of a text are its runs of 1 to 3 consecutive words; a feature's bucket is its
CRC-32 modulo ``BUCKETS``.  ``count_blocks`` turns documents into a sparse document by
bucket count matrix, in CSR blocks: one row of the table holds some documents
(``docs``), where each one's entries begin (``starts``), and the entries (``buckets``,
``counts``).  The blocks are written once.  Their column sums, and those of the target's
blocks, give the two distributions; the gains of the buckets are a vector of fixed length
(``BUCKETS``), and every block times that vector gives its documents' weights.  Gumbel
noise from a hash of the id makes a draw without replacement of the highest scores.

CRC-32 is linear: the sum of "a b" follows from those of "a" and " b" by a table look-up
for the length of " b".  So every word is hashed once, and n-grams by array arithmetic.

Null and empty texts, and texts without words, have no features and weight 0; with fewer
than ``least_words`` words a document isn't drawn.  A very long text is one row of a
block with at most ``BUCKETS`` entries.  Repeated rows count, and are drawn, each for
itself; ties go to the smaller id, null ids come last and are hashed as ``null``.  An empty
table gives no rows, an empty target gives gains from the documents alone.  Of further
columns none is read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables, textnum

BUCKETS, LONGEST = 10_000, 3
#: Bytes of text whose features are held at a time, entries of a block, and bytes of blocks that are read at a time.
GROUP_BYTES, BLOCK_ENTRIES, ROW_GROUP = 1 << 20, 1 << 14, 4 << 20
BLOCKS = "docs array<bigint>, words array<bigint>, features array<bigint>, starts array<int>, buckets array<int>, counts array<int>"

#: Word bytes: digits, lower-case letters, and every byte of a character beyond ASCII.
_WORDS = np.zeros(256, np.uint8)
_WORDS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_SHORT = 64  # lengths with a shift table of their own

#: The byte table of CRC-32, by its linearity out of the library's function.
_STEP = np.array([zlib.crc32(bytes([v])) ^ zlib.crc32(b"\0") for v in range(256)], np.uint32)


def _shifted(table: np.ndarray, crc: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    out = np.zeros(crc.shape, np.uint32)
    for k in range(4):
        out ^= table[n, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """[n, k, v]: what byte k of a CRC, of value v, becomes when n (or 2 ** n) zero bytes follow."""
    each, doubled = np.zeros((_SHORT + 1, 4, 256), np.uint32), np.zeros((40, 4, 256), np.uint32)
    each[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, _SHORT + 1):
        each[n] = (each[n - 1] >> np.uint32(8)) ^ _STEP[each[n - 1] & np.uint32(255)]
    doubled[0] = each[1]
    for k in range(1, len(doubled)):
        doubled[k] = _shifted(doubled, doubled[k - 1], k - 1)
    return each, doubled


_each, _doubled = _shift_tables()


def _after_zeros(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The linear part of a CRC when n[i] zero bytes follow."""
    short = np.minimum(n, _SHORT)
    out, left = _shifted(_each, crc, short), n - short
    for k in range(int(left.max(initial=0)).bit_length()):
        some = np.flatnonzero(left >> k & 1)
        out[some] = _shifted(_doubled, out[some], k)
    return out


def _word_crcs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of every word, and of the word with a blank before it: all words advance one byte at a time, the longest first."""
    order = np.argsort(starts - ends, kind="stable")
    begin, length = starts[order], (ends - starts)[order]
    out = np.empty((2, len(order)), np.uint32)
    long = int(np.searchsorted(-length, -_SHORT, "left"))  # so many words are longer than _SHORT
    for i in range(long):
        word = buf[begin[i] : begin[i] + length[i]].tobytes()
        out[:, order[i]] = zlib.crc32(word), zlib.crc32(b" " + word)
    begin, length, order = begin[long:], length[long:], order[long:]
    registers = np.empty((2, len(order)), np.uint32)
    registers[0], registers[1] = 0xFFFFFFFF, zlib.crc32(b" ") ^ 0xFFFFFFFF
    for j in range(int(length[0]) if len(length) else 0):
        n = int(np.searchsorted(-length, -j, "left"))  # words with more than j bytes
        byte = buf[begin[:n] + j]
        for register in registers:
            register[:n] = _STEP[(register[:n] ^ byte) & np.uint32(255)] ^ (register[:n] >> np.uint32(8))
    out[:, order] = registers ^ np.uint32(0xFFFFFFFF)
    return out


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every feature of a column of texts, and the words of each row."""
    buf, offsets = textnum.buffers(column)
    buf = textnum.LOWER_AZ[buf]
    starts, ends = textnum.spans(buf, offsets, _WORDS)
    bounds = np.searchsorted(starts, offsets, "left")
    plain, blank = _word_crcs(buf, starts, ends)
    rows = textnum.row_ids(bounds).astype(np.int64)
    out_rows, out_crcs = [rows], [plain]
    grams = plain
    for n in range(2, LONGEST + 1):
        last = slice(n - 1, None)
        grams = _after_zeros(grams[:-1] if len(grams) else grams, (ends - starts)[last] + 1) ^ blank[last]
        inside = rows[last] == rows[: len(rows) - n + 1] if len(rows) >= n else np.empty(0, bool)
        out_rows.append(rows[last][inside])
        out_crcs.append(grams[inside])
    return np.concatenate(out_rows), np.concatenate(out_crcs) % np.uint32(BUCKETS), np.diff(bounds)


def _block(ids: list[pa.Array], *parts: list[np.ndarray]) -> pa.RecordBatch:
    """One row of ``BLOCKS`` from what successive slices of documents hold: ids, words, entries a document, buckets, counts."""
    doc = pa.concat_arrays(ids)
    words, size, bucket, count = map(np.concatenate, parts)
    starts = np.append(0, np.cumsum(size))
    upto = np.append(0, np.cumsum(count))[starts]
    columns = (doc, words, np.diff(upto), starts, bucket, count)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    arrays = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), (c if isinstance(c, pa.Array) else pa.array(c)).cast(kind)) for c, kind in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split(" ")[0] for c in BLOCKS.split(", ")])


def count_blocks(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """The count matrix of ``df`` in CSR blocks of about ``block_entries`` entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = ([], [], [], [], [])
        filled = 0
        for batch in batches:
            for first, texts in textnum.byte_slices(batch.column(1), GROUP_BYTES):
                row, bucket, words = features(texts)
                key, count = np.unique(row * BUCKETS + bucket, return_counts=True)
                size = np.bincount(key // BUCKETS, minlength=len(texts))
                # Cut where a block is full; a row is never divided.
                at, ends = 0, np.cumsum(size)
                while at < len(texts):
                    begin = ends[at - 1] if at else 0
                    upto = min(len(texts), int(np.searchsorted(ends, begin + block_entries - filled, "left")) + 1)
                    ids = batch.column(0).slice(first + at, upto - at)
                    for part, own in zip(held, (ids, words[at:upto], size[at:upto], key[begin : ends[upto - 1]] % BUCKETS, count[begin : ends[upto - 1]])):
                        part.append(own)
                    filled, at = filled + int(ends[upto - 1] - begin), upto
                    if filled >= block_entries:
                        yield _block(*held)
                        held, filled = ([], [], [], [], []), 0
        if held[0]:
            yield _block(*held)

    return tables.small_batches(df).select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`")).mapInArrow(run, BLOCKS)


def column_sums(blocks: DataFrame) -> list[int]:
    """Features in each bucket: every task adds its blocks up, so ``BUCKETS`` sums a task are all that moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            bucket, count = (c.flatten().to_numpy(zero_copy_only=False) for c in batch.columns)
            np.add.at(total, bucket, count)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array(total)], names=["bucket", "n"])

    sums = blocks.select("buckets", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS rows at most
    out = [0] * BUCKETS
    for bucket, n in sums:
        out[bucket] = n
    return out


def gains(own: list[int], target: list[int]) -> list[int]:
    """floor(1000 * ln) of each bucket's smoothed share in the target against its share in the documents."""
    all_own, all_target = sum(own), sum(target)
    return [math.floor(1000 * math.log(float(t + 1) * float(all_own + BUCKETS) / (float(s + 1) * float(all_target + BUCKETS)))) for s, t in zip(own, target)]


def weights(blocks: DataFrame, gain: list[int]) -> DataFrame:
    """(doc_id, n_words, n_features, weight): every block of the matrix times the gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.array(gain, np.int64)
        for batch in batches:
            for block in range(batch.num_rows):
                docs, words, features_, starts, bucket, count = (c[block].values for c in batch.columns)
                starts = starts.to_numpy()
                sums = np.append(0, np.cumsum(vector[bucket.to_numpy()] * count.to_numpy()))
                yield pa.RecordBatch.from_arrays([docs, words, features_, pa.array(sums[starts[1:]] - sums[starts[:-1]])], names=["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(df: DataFrame, target: DataFrame, *, percent: int = 5, least_words: int = 20, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``df``.

    ``rank`` is 1, 2, 3... over the drawn documents, floor(percent / 100) of those with at
    least ``least_words`` words, in the order of their scores; null elsewhere.
    """
    scratch = tables.Scratch(df.sparkSession, "importance")
    blocks = scratch.stage(count_blocks(df, doc_id, text), "blocks", ROW_GROUP)
    wanted = count_blocks(target.select(F.lit(None).cast("long").alias("id"), F.col(f"`{text}`").alias("text")), "id", "text")
    gain = gains(column_sums(blocks), column_sums(wanted))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = weights(blocks, gain).withColumn("score", F.col("weight") + noise).withColumn("open", F.col("n_words") >= least_words)
    # One global order without one task for it: a range of scores a partition, and how many rows stand in the ranges before.
    order = [F.desc("open"), F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_features")]
    sorted_ = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    own_row = F.monotonically_increasing_id()
    placed = scratch.stage(sorted_.withColumn("part", F.shiftright(own_row, 33).cast("int")).withColumn("place", own_row.bitwiseAND(F.lit((1 << 33) - 1))), "placed")
    scratch.remove("blocks")
    counts = placed.groupBy("part").agg(F.count("*").alias("n"), F.count_if("open").alias("open")).sort("part").collect()  # one row for each range
    drawn = percent * sum(r["open"] for r in counts) // 100
    before, ahead = 0, []
    for r in counts:
        ahead.append((r["part"], before))
        before += r["n"]
    ranges = df.sparkSession.createDataFrame(ahead, "part int, ahead long")
    rank = F.col("ahead") + F.col("place") + 1
    placed = placed.join(F.broadcast(ranges), "part")  # one row for each range
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("open") & (rank <= drawn), rank).alias("rank"))
