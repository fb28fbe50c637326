"""Language identification by mixture inference.

A model holds, for each language, smoothed probabilities of letter n-grams (three
bytes of UTF-8 with word edges, hashed to ``2**BITS`` buckets).  A document is a
mixture: each word comes from one language with the product of its n-grams'
probabilities, and expectation-maximisation estimates the languages' proportions.
Languages are taken into the document's set, largest proportion first, as long as
the likelihood gains more than ``penalty * ln(1 + words)`` for each (sets of two and
three are always tried, a larger one where the set before gained); the prediction is
the set's largest member and the score its proportion.

Counts come from a sample of at most about ``max_docs`` labelled documents of each
language, chosen by a hash of doc_id.  They are summed before they are gathered, so
what reaches the driver is ``2**BITS`` counts of each language at most.  A text of over
``BLOCK`` words is gone through in blocks of words whose sums are added up per step.

Null texts and texts without a letter are ``und`` with score 0, and so is every
text where there was nothing to learn from.  Ties go to the first language in
alphabetical order.  Null labels are not learned from.  Every task holds a table of all languages, so more
than ``max_langs`` different labels raise an error; none is left out.
Repeated rows are predicted each for itself.  Other columns pass through; one that is
named as a result keeps its values under that name with ``_in`` behind it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables, textnum

BITS, SMOOTHING = 16, 0.5
MAX_DOCS, STEPS, PENALTY, TRIED_SET, BLOCK = 4_000, 12, 3.0, 3, 200_000
MAX_LANGS = 200
_PIECE = 1 << 19
#: Columns of ``with_language``.
RESULTS = ("lang_pred", "lang_score")

#: Bytes of letters (all of non-ASCII) stay, others become 0, the word edge.
_LETTERS = np.zeros(256, np.uint8)
for _b in [*range(97, 123), *range(128, 256)]:
    _LETTERS[_b] = _b
_IS_LETTER = (_LETTERS != 0).astype(np.uint8)


def grams(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, where each word's begin, and each row's first word (with a last bound)."""
    buf, offsets = textnum.buffers(pc.utf8_lower(column.cast(pa.large_string())))
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    x = _LETTERS[buf].astype(np.uint32)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    edges = offsets[(offsets > 0) & (offsets < len(buf))]
    before[edges] = 0
    after[edges - 1] = 0
    keep = np.flatnonzero(x)
    key = (before[keep] << np.uint32(16)) | (x[keep] << np.uint32(8)) | after[keep]
    buckets = ((key * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)
    starts = np.flatnonzero(before[keep] == 0)
    return buckets, starts, np.searchsorted(keep[starts], offsets, "left")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        langs = np.array(b.column(1).to_pylist(), object)
        for lang in dict.fromkeys(langs):
            rows = np.flatnonzero(langs == lang)
            for i in range(0, len(rows), 128):
                found = np.bincount(grams(b.column(0).take(pa.array(rows[i : i + 128])))[0], minlength=1 << BITS)
                sums[lang] = sums.get(lang, 0) + found
    for lang, counts in sums.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "bucket", "n"])


def log_table(found: pa.Table) -> tuple[list[str], np.ndarray]:
    """Languages in order and their log probabilities (buckets x languages), from rows of lang, bucket and n."""
    names = found["lang"].to_pylist()
    langs = sorted(set(names))
    place = {lang: i for i, lang in enumerate(langs)}
    table = np.full((1 << BITS, len(langs)), SMOOTHING)
    np.add.at(table, (found["bucket"].to_numpy(), np.array([place[x] for x in names], np.int64)), found["n"].to_numpy())
    return langs, np.log(table / table.sum(0)).astype(np.float32)


def fit(docs: DataFrame, *, max_docs: int = MAX_DOCS, max_langs: int = MAX_LANGS) -> tuple[list[str], np.ndarray]:
    """Languages in order and their log probabilities (buckets x languages), from (doc_id, text, lang)."""
    known = tables.small_batches(docs).filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_langs + 1).collect()}
    if len(sizes) > max_langs:
        raise ValueError(f"more than {max_langs} languages: every task holds a table of all of them, so raise max_langs if memory allows")
    if not sizes:
        return [], np.zeros((1 << BITS, 0))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1_000_000, int(1_000_000 * max_docs / n) + 1))])
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")])
    counts = chosen.select("text", "lang").mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return log_table(counts.toArrow())


def _mixture(likely: np.ndarray, rows: np.ndarray, bounds: np.ndarray, start: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (rows x languages) by expectation-maximisation from ``start``, and the log likelihood under them."""
    share, n = start, np.maximum(np.diff(bounds), 1)[:, None]
    for _ in range(steps):
        own = likely * share[rows]
        own /= own.sum(1, keepdims=True)
        share = textnum.segment_sums(own, bounds) / n
    return share, textnum.segment_sums(np.log((likely * share[rows]).sum(1)), bounds)


def _long(buckets: np.ndarray, starts: np.ndarray, table: np.ndarray, penalty: float, steps: int) -> tuple[int, float]:
    """What ``infer`` gives for one text, in blocks of words."""
    n, k = len(starts), table.shape[1]
    logs = np.empty((n, k), np.float32)
    ends = np.append(starts, len(buckets))
    blocks = [slice(i, min(i + BLOCK, n)) for i in range(0, n, BLOCK)]
    for b in blocks:
        logs[b] = np.add.reduceat(table[buckets[ends[b.start] : ends[b.stop]]], starts[b] - starts[b.start], axis=0)

    def likely(b: slice) -> np.ndarray:
        return np.exp(np.maximum(logs[b].astype(np.float64) - logs[b].max(1, keepdims=True), -60.0))

    def mixture(share: np.ndarray, floor: float) -> tuple[np.ndarray, float]:
        for _ in range(steps):
            total = np.zeros(k)
            for b in blocks:
                own = (likely(b) + floor) * share
                total += (own / own.sum(1, keepdims=True)).sum(0)
            share = total / n
        return share, sum(np.log((likely(b) + floor) @ share).sum() for b in blocks)

    base = sum(logs[b].max(1).sum(dtype=np.float64) for b in blocks)
    alone = sum(np.maximum(logs[b], logs[b].max(1, keepdims=True) - 60.0).sum(0, dtype=np.float64) for b in blocks)
    best = int(alone.argmax())
    share, full = mixture(np.full(k, 1 / k), 0.0)
    part, reached, cost = share[best], alone.max(), penalty * np.log1p(n)
    if full + base - reached > cost:
        order = np.argsort(-share, kind="stable")
        for size in range(2, k + 1):
            begin = np.zeros(k)
            begin[order[:size]] = share[order[:size]] + 1e-6
            got, ll = mixture(begin / begin.sum(), 1e-30)
            ll += base - cost * (size - 1)
            if ll > reached:
                reached, best, part = ll, int(got.argmax()), got.max()
            elif size >= TRIED_SET:
                break
    return best, part


def infer(column, table: np.ndarray, *, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """For every text the most likely set's largest language (index, -1 without words) and its proportion."""
    buckets, starts, words = grams(column)
    count, k = np.diff(words), table.shape[1]
    best, part = np.full(len(count), -1), np.zeros(len(count))
    if not len(starts) or not k:
        return best, part
    long = np.flatnonzero(count > BLOCK)
    if len(long):
        ends = np.append(starts, len(buckets))
        for i in long:
            a, b = words[i], words[i + 1]
            best[i], part[i] = _long(buckets[starts[a] : ends[b]], starts[a:b] - starts[a], table, penalty, steps)
        short = np.flatnonzero(count <= BLOCK)
        if len(short):
            best[short], part[short] = infer(column.take(pa.array(short)), table, penalty=penalty, steps=steps)
        return best, np.clip(part, 0.0, 1.0)
    bounds = words
    logs = np.add.reduceat(table[buckets], starts, axis=0).astype(np.float64)
    rows = textnum.row_ids(bounds)
    top = logs.max(1, keepdims=True)
    likely, base = np.exp(np.maximum(logs - top, -60.0)), textnum.segment_sums(top[:, 0], bounds)
    alone = textnum.segment_sums(np.maximum(logs, top - 60.0), bounds)
    single = alone.argmax(1)
    share, full = _mixture(likely, rows, bounds, np.full((len(count), k), 1 / k), steps)
    some = np.flatnonzero(count > 0)
    best[some], part[some] = single[some], share[some, single[some]]
    cost = penalty * np.log1p(count)
    open_rows = some[full[some] + base[some] - alone.max(1)[some] > cost[some]]
    if len(open_rows):
        reached = alone.max(1)
        for size in range(2, k + 1):
            pick = np.isin(rows, open_rows)
            sub_rows = np.searchsorted(open_rows, rows[pick])
            sub_bounds = np.concatenate([[0], np.cumsum(np.diff(bounds)[open_rows])])
            mask = np.zeros((len(open_rows), k))
            np.put_along_axis(mask, np.argsort(-share[open_rows], axis=1, kind="stable")[:, :size], 1.0, 1)
            begin = (share[open_rows] + 1e-6) * mask
            got, ll = _mixture(likely[pick] + 1e-30, sub_rows, sub_bounds, begin / begin.sum(1, keepdims=True), steps)
            ll = ll + base[open_rows] - cost[open_rows] * (size - 1)
            better = ll > reached[open_rows]
            at = open_rows[better]
            reached[at] = ll[better]
            best[at] = got[better].argmax(1)
            part[at] = got[better].max(1)
            if size >= TRIED_SET:
                open_rows = at
            if not len(open_rows):
                break
    return best, np.clip(part, 0.0, 1.0)


def with_language(df: DataFrame, training: DataFrame, *, text: str = "text", max_docs: int = MAX_DOCS, penalty: float = PENALTY) -> DataFrame:
    """``df`` with lang_pred and lang_score; ``training`` has doc_id, text and lang."""
    langs, table = fit(training, max_docs=max_docs)
    df, names = tables.set_aside(df, RESULTS)
    text = f"`{names[text]}`"
    shared = df.sparkSession.sparkContext.broadcast((langs, table))
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))

    @F.arrow_udf("struct<lang:string,score:double>")
    def guess(column: pa.Array) -> pa.Array:
        names, model = shared.value
        piece = max(1, _PIECE // max(1, model.shape[1] // 4))
        best, score = [], []
        for _, part in textnum.byte_slices(column, piece):
            b, s = infer(part, model, penalty=penalty)
            best += [names[x] if x >= 0 else "und" for x in b]
            score += s.tolist()
        return pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    own = tables.fresh(df, "guess_")
    found = df.withColumn(own, guess(F.col(text)))
    return (
        found.withColumn("lang_pred", F.when(letters, F.col(own)["lang"]).otherwise("und"))
        .withColumn("lang_score", F.when(letters, F.col(own)["score"]).otherwise(0.0))
        .drop(own)
    )


def learnable(doc_id: Column, parts: int = 3, kept_out: int = 1) -> Column:
    """Whether this document's language may be learned from."""
    return ~F.coalesce(F.crc32(doc_id.cast("string")) % parts == kept_out, F.lit(False))
