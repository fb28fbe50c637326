"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector is a sparse row of terms (its positions) with integer weights.  The
candidates are dealt to groups of about ``group_rows`` rows; a task turns one
group into postings (term -> rows and weights), then takes the query rows in
blocks: for each term, the query weights times the postings are added to a dense
score array.  Partition selection keeps the k best of each group, and a ranking
over the groups' winners merges them.  Queries are sent once to each group, in
blocks; nothing is broadcast, and no pair is written but the k best of a group.

Vectors that are null, or hold a null or non-finite component, take no part.
Vectors of different lengths score over the positions they share; an empty one
scores 0.  Ties go to the smaller id.  Scores are exact within the range of long; one
beyond it counts as the range's end, and so does a component after scaling.

Rows that share an id are candidates each for itself, and a query skips every candidate
that has its own id.  Query rows that are alike ask once; different ones that share an
id have a ranking each.  Fewer than k candidates give fewer rows; no query or no
candidate gives none.  Columns other than ``vec_id`` and ``weights`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Candidates of a group, and the fewest for which another group is opened to keep all cores busy.
GROUP_ROWS, LEAST_ROWS, QUERY_BLOCK = 16_384, 1024, 64
SCHEMA = "query_id long, query_key long, vec_id long, score long"
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as bigint, null for vectors that take no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint")))


def _size(weights: np.ndarray) -> int:
    return max(int(weights.max(initial=0)), -int(weights.min(initial=0)))


class Postings:
    """An inverted index of one group of candidates, ordered by id."""

    def __init__(self, ids: np.ndarray, rows: list[np.ndarray]) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        lengths = np.array([len(rows[i]) for i in order])
        at = np.repeat(np.arange(len(order)), lengths)
        terms = np.concatenate([np.arange(n) for n in lengths]) if len(order) else np.empty(0, np.int64)
        weights = np.concatenate([rows[i] for i in order]) if len(order) else np.empty(0, np.int64)
        some = weights != 0
        at, terms, weights = at[some], terms[some], weights[some]
        by_term = np.argsort(terms, kind="stable")
        self.at, self.weights = at[by_term], weights[by_term]
        self.bounds = np.searchsorted(terms[by_term], np.arange(lengths.max(initial=0) + 1))
        self.largest = _size(weights)

    def scores(self, queries: list[np.ndarray]) -> np.ndarray:
        """Dense scores (queries x candidates), one term after the other."""
        width = max(map(len, queries), default=0)
        top = max(map(_size, queries), default=0)
        kind = np.int64 if top * self.largest * max(1, width) < 1 << 63 else object
        out = np.zeros((len(queries), len(self.ids)), kind)
        weights = np.zeros((width, len(queries)), kind)
        for i, q in enumerate(queries):
            weights[: len(q), i] = q
        for term in range(min(width, len(self.bounds) - 1)):
            a, b = self.bounds[term], self.bounds[term + 1]
            of = np.flatnonzero(weights[term])
            if a < b and len(of):
                post = self.weights[a:b].astype(kind)
                if len(of) == len(queries) and b - a == len(self.ids):
                    out += weights[term][:, None] * post[None, :]
                else:
                    out[of[:, None], self.at[a:b][None, :]] += weights[term][of][:, None] * post[None, :]
        return out if kind is np.int64 else np.clip(out, _LOW, _HIGH)

    def best(self, query_ids: list[tuple[int, int]], queries: list[np.ndarray], k: int) -> Iterator[tuple[int, int, int, int]]:
        """(query, its key, candidate, score) of the k best of this group for each query, ties to smaller ids."""
        for (query, own_key), row in zip(query_ids, self.scores(queries), strict=True):
            own = slice(*np.searchsorted(self.ids, [query, query + 1]))
            keep = np.ones(len(row), bool)
            keep[own] = False
            rows = np.flatnonzero(keep)
            if not len(rows):
                continue
            s = row[rows]
            if len(rows) > k:
                edge = np.partition(s, len(s) - k)[len(s) - k]
                above = np.flatnonzero(s > edge)
                chosen = np.concatenate([above, np.flatnonzero(s == edge)[: k - len(above)]])
            else:
                chosen = np.arange(len(rows))
            for i in chosen:
                yield query, own_key, int(self.ids[rows[i]]), int(s[i])


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows come by group, candidates before queries."""
    group, index = None, None
    ids: list[int] = []
    rows: list[np.ndarray] = []
    pending: tuple[list[tuple[int, int]], list[np.ndarray]] = ([], [])

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal pending, index
        if pending[0] and ids:
            index = index or Postings(np.array(ids, np.int64), rows)
            found = list(index.best(*pending, k))
            columns = list(zip(*found, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "query_key", "vec_id", "score"])
        pending = ([], [])

    for b in batches:
        values = b.column(3)
        flat, bounds = values.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        for i, (g, role, key, own_key) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 1, 2, 4)), strict=True)):
            if g != group:
                yield from flush()
                group, index, ids, rows = g, None, [], []
            row = flat[bounds[i] : bounds[i + 1]].astype(np.int64)
            if role == 0:
                ids.append(key)
                rows.append(row)
            else:
                pending[0].append((key, own_key))
                pending[1].append(row)
                if len(pending[0]) >= QUERY_BLOCK:
                    yield from flush()
    yield from flush()


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, *, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest integer inner products of every query.

    Both inputs have ``vec_id`` and ``weights`` (array of bigint, null: takes no part).
    """
    own = candidates.select("vec_id", "weights").filter("weights IS NOT NULL AND vec_id IS NOT NULL")
    asked = queries.select("vec_id", "weights").filter("weights IS NOT NULL AND vec_id IS NOT NULL").distinct()
    n = candidates.count()
    groups = max(1, -(-n // group_rows), min(candidates.sparkSession.sparkContext.defaultParallelism, n // LEAST_ROWS))
    # Rows that share an id are spread by what they hold, and equal rows by where they are read.
    group = F.pmod(F.xxhash64("vec_id", "weights", F.spark_partition_id()), F.lit(groups)).cast("int")
    dealt = own.select(group.alias("g"), F.lit(0).alias("role"), "vec_id", "weights", F.lit(0).cast("bigint").alias("query_key"))
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("role"), "vec_id", "weights", F.xxhash64("weights").alias("query_key"))
    found = (
        dealt.union(sent)
        .repartitionById(groups, F.col("g"))
        .sortWithinPartitions("g", "role")
        .mapInArrow(lambda batches: _search(batches, k), SCHEMA)
    )
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
