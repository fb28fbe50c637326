"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Words are runs of letters, of digits or of other marks, A-Z lower-cased; features
are single words and pairs of neighbours, hashed to ``2**bits`` buckets, where a
word that follows itself goes to one bucket shared by all words.  A document is
the sparse vector of its n-grams' shares, times ``SCALE``, and its score the
logistic function of one sparse dot product with the weights.

Training takes a sample of at most about ``max_docs`` labelled documents, chosen
by a hash of doc_id, in shards of about ``SHARD_DOCS`` each.  FTRL-proximal runs over every
shard in ``epochs`` passes; the weights are the shards' mean (``2**bits`` numbers of
each shard, so what reaches the driver is bounded by the parameters).

Null and empty texts have no n-grams and get the bias alone.  Null labels are not
learned from; a document labelled twice is learned twice.  Without any labelled
document nothing is known against a text and every score is 1.  Very long texts are
scored whole.  Other columns pass through; one that is named as a result keeps its
values under that name with ``_in`` behind it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tables, textnum

BITS, SCALE = 18, 16.0
ALPHA, BETA, L1, L2 = 0.5, 0.1, 1e-4, 1e-4
MAX_DOCS, SHARD_DOCS, EPOCHS, BATCH = 16_000, 2_000, 3, 8
THRESHOLD = 0.7
#: Columns of ``with_quality``.
RESULTS = ("quality_score", "quality_predicted")
_PAIR = np.uint64(0x9FB21C651E98DF25)
_SAME = np.uint64(0x5851F42D4C957F2D)


def gram_buckets(column, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and neighbouring pairs of a column, row by row, and row bounds."""
    words, bounds = textnum.word_hashes(column, textnum.CLASS_WORDS)
    n = np.diff(bounds)
    shift = np.uint64(64 - bits)
    out_bounds = np.concatenate([[0], np.cumsum(np.maximum(2 * n - 1, 0))])
    out = np.empty(out_bounds[-1], np.int64)
    rows = textnum.row_ids(bounds)
    at = np.arange(len(words)) - bounds[:-1][rows] + out_bounds[:-1][rows]
    out[at] = (words >> shift).astype(np.int64)
    if len(words) > 1:
        pairs = textnum.mix(words[:-1] * _PAIR + words[1:])
        pairs[words[:-1] == words[1:]] = _SAME
        inside = rows[:-1] == rows[1:]
        r = rows[1:][inside]
        second = np.flatnonzero(inside) + 1 - bounds[:-1][r]  # the pair's second word in its row
        out[out_bounds[:-1][r] + n[r] + second - 1] = (pairs[inside] >> shift).astype(np.int64)
    return out, out_bounds


class Ftrl:
    """FTRL-proximal logistic regression on sparse rows; updates in small batches."""

    def __init__(self, bits: int = BITS) -> None:
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)  # the last is the bias

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, features: np.ndarray, values: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> None:
        """One step over several documents; (features, values, rows) are their sparse entries, bias included."""
        at, place = np.unique(features, return_inverse=True)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[place] * values, len(labels)), -35, 35)))
        g = np.bincount(place, (p - labels)[rows] * values, len(at))
        grown = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] = grown


def _train(batches: Iterator[pa.RecordBatch], bits: int, epochs: int) -> Iterator[pa.RecordBatch]:
    """Rows come by shard; each shard gives one row of weights, whatever tasks it is dealt to."""
    shard: int | None = None
    docs: list[tuple[np.ndarray, np.ndarray]] = []
    labels: list[int] = []

    def close() -> pa.RecordBatch:
        model, y = Ftrl(bits), np.array(labels, float)
        for _ in range(epochs):
            for i in range(0, len(docs), BATCH):
                some = docs[i : i + BATCH]
                features = np.concatenate([np.append(f, 1 << bits) for f, _ in some])
                values = np.concatenate([np.append(v, 1.0) for _, v in some])
                rows = np.repeat(np.arange(len(some)), [len(f) + 1 for f, _ in some])
                model.learn(features, values, rows, y[i : i + BATCH])
        return pa.RecordBatch.from_pydict({"docs": [len(docs)], "weights": [model.weights().astype("<f4").tobytes()]}, pa.schema([("docs", pa.int64()), ("weights", pa.binary())]))

    for b in batches:
        for i in range(0, len(b), 64):
            part = b.slice(i, 64)
            buckets, bounds = gram_buckets(part.column(0), bits)
            for k, (label, own) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                if own != shard:
                    if docs:
                        yield close()
                    shard, docs, labels = own, [], []
                found, counts = np.unique(buckets[bounds[k] : bounds[k + 1]], return_counts=True)
                docs.append((found.astype(np.int32), (counts * (SCALE / max(1, counts.sum()))).astype(np.float32)))
                labels.append(label)
    if docs:
        yield close()


def learnable(doc_id: Column, parts: int = 4, kept_out: int = 2) -> Column:
    """Whether labels of this document may be learned from."""
    return ~F.coalesce(F.crc32(doc_id.cast("string")) % parts == kept_out, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, bits: int = BITS, max_docs: int = MAX_DOCS, epochs: int = EPOCHS) -> np.ndarray | None:
    """Weights (the bias last) from labelled documents: ``labels`` has doc_id and quality (0 or 1)."""
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_label"))
    n = known.count()
    known = known.withColumn("_order", F.xxhash64("_id"))
    if n > max_docs:
        known = known.filter(F.pmod("_order", F.lit(1_000_000)) < int(1_000_000 * max_docs / n))
    # At most about max_docs narrow rows, whatever the input's size.
    chosen = tables.small_batches(docs).select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text")).join(F.broadcast(known), F.col("_doc") == F.col("_id"))
    shards = max(1, -(-min(n, max_docs) // SHARD_DOCS))
    dealt = chosen.withColumn("_shard", F.pmod("_order", F.lit(shards))).repartition(shards, "_shard")
    dealt = dealt.sortWithinPartitions("_shard", "_order", "_id", "_label").select("_text", "_label", "_shard")
    found = dealt.mapInArrow(lambda batches: _train(batches, bits, epochs), "docs long, weights binary").collect()
    if not found:
        return None
    total = sum(r["docs"] for r in found)
    return sum(np.frombuffer(r["weights"], "<f4").astype(float) * (r["docs"] / total) for r in found).astype(np.float32)


def score_texts(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    """The logistic function of each text's sparse dot product."""
    bits = (len(weights) - 1).bit_length() - 1
    out = []
    for _, part in textnum.byte_slices(column):
        buckets, bounds = gram_buckets(part, bits)
        n = np.diff(bounds)
        dots = textnum.segment_sums(weights[buckets], bounds) * SCALE / np.maximum(n, 1) + weights[-1]
        out.append(1 / (1 + np.exp(-np.clip(dots, -35, 35))))
    return np.concatenate(out) if out else np.empty(0)


def quality_score(text: Column, weights: np.ndarray | None, spark) -> Column:
    """Column: the score of ``text``, 0 to 1."""
    if weights is None:
        return F.lit(1.0)
    shared = spark.sparkContext.broadcast(weights)

    @F.arrow_udf(T.DoubleType())
    def score(column: pa.Array) -> pa.Array:
        return pa.array(score_texts(column, shared.value), pa.float64())

    return score(text)


def with_quality(df: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, max_docs: int = MAX_DOCS) -> DataFrame:
    """``df`` with quality_score and quality_predicted, learned from the labels that may be learned from."""
    weights = fit(df, labels.filter(learnable(F.col("doc_id"))), max_docs=max_docs)
    df, names = tables.set_aside(df, RESULTS)
    scored = df.withColumn("quality_score", quality_score(F.col(f"`{names['text']}`"), weights, df.sparkSession))
    return scored.withColumn("quality_predicted", (F.col("quality_score") >= threshold).cast("int"))
