"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

A text, with a blank before it, is encoded by A (byte-level BPE, a tokenizers file) and
by B (a sentencepiece model, which adds the blank itself).  Byte offsets where tokens of
both end cut the tokens into groups; two tokens are linked where their bytes overlap.

``alignments`` gives a row for each document, and rows of *postings*: for each id of B, in
each block of documents, the ids of A that it is linked with, and for each such pair the
documents and how often.  ``link_scores`` writes that table and cogroups it by the id of
B: sorted streams bring an id's corpus-wide pair counts first, then its postings; a task
looks up counts and the maximum, and gives what they contribute to documents; sums
by document follow.  The ids are dealt to ``SIDES`` shares, and the postings of each share
by groups of ``GROUP_BLOCKS`` blocks of documents, so that no id is one task's, however
often it occurs: a group gets the id's counts (as many as A has ids at most), and a
document has as many contributions as there are shares, whatever the corpus.

Words (cut in front of a blank behind something else) are encoded once a group of about
``GROUP_BYTES`` and remembered: no token of A crosses such a cut, since its pattern ends
there, and none of B as long as none of its pieces holds a blank behind something else,
which is checked.  Sums over words and documents are the same as over whole texts.

Null and empty texts, and texts whose tokens don't give their bytes again (such as those
that hold U+2581 themselves), have no tokens: zeros and no groups.  Special tokens'
strings inside texts are ordinary text.  Repeated rows and ids are documents each for
itself; columns other than the text pass through, those named as results with ``_in``
behind their names.  A very long text is encoded whole in one task, in parts by words.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables, textnum, tokens

#: Bytes of text that are taken at a time; links and documents of a block; words that a worker remembers, their bytes, and the longest.
GROUP_BYTES, BLOCK_LINKS, BLOCK_DOCS, KNOWN_WORDS, KNOWN_BYTES, KNOWN_LENGTH = 2 << 20, 1 << 21, 1 << 14, 300_000, 16 << 20, 64
#: Shares of the ids of B, blocks of a group whose documents a task sums up, documents of a row of sums, and bytes of postings read at a time.
SIDES, GROUP_BLOCKS, SUM_DOCS, ROW_GROUP = 64, 128, 256, 8 << 20

RESULTS = ("n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum")
POSTINGS = "b int, block long, a array<int>, ends array<int>, at array<smallint>, n array<int>"
_coders: dict[tuple[str, str], "PairCoder"] = {}


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """The bytes of all ids, one after the other."""

    def __init__(self, entries: list[bytes]) -> None:
        self.sizes = np.array([len(e) for e in entries], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[tokens.ragged(self.starts[ids], self.sizes[ids])]


class Side:
    """Ids of the words that a worker knows, for one vocabulary."""

    def __init__(self) -> None:
        self.sizes, self.flat = np.empty(0, np.int64), np.empty(0, np.int32)

    def add(self, encoded: list[list[int]]) -> None:
        self.sizes = np.append(self.sizes, np.array([len(e) for e in encoded], np.int64))
        self.flat = np.append(self.flat, np.fromiter((i for e in encoded for i in e), np.int32))

    def ids(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[words]
        return sizes, self.flat[tokens.ragged((np.cumsum(self.sizes) - self.sizes)[words], sizes)]

    def keep(self, words: np.ndarray) -> None:
        self.sizes, self.flat = self.ids(words)


class PairCoder:
    """Encodes words with both vocabularies, and remembers them."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("the model has pieces that hold a blank behind something else: words can't be encoded separately")
        byte_of = _byte_of()
        spelled = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = Vocabulary([bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in spelled])
        self.bytes_b = Vocabulary([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.words = pa.array([], pa.string())
        self.sides = (Side(), Side())
        self.right = np.empty(0, bool)

    def known(self, words: pa.Array) -> np.ndarray:
        """The place of every word; new ones are encoded."""
        if len(self.words) > KNOWN_WORDS or self.words.nbytes > KNOWN_BYTES:
            short = np.flatnonzero(pc.binary_length(self.words).to_numpy() <= KNOWN_LENGTH)[-KNOWN_WORDS // 2 :]
            self.words, self.right = self.words.take(pa.array(short)), self.right[short]
            for side in self.sides:
                side.keep(short)
        found = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().copy()
        new = np.flatnonzero(found < 0)
        if len(new):
            unknown = words.take(pa.array(new))
            texts = unknown.to_pylist()
            encoded = ([e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.b.encode([t[1:] for t in texts], num_threads=1))
            found[new] = np.arange(len(self.words), len(self.words) + len(new))
            self.words = pa.concat_arrays([self.words, unknown])
            first = [len(side.sizes) for side in self.sides]
            for side, ids in zip(self.sides, encoded):
                side.add(ids)
            self.right = np.append(self.right, self._spelled_again(unknown, *(np.arange(k, k + len(new)) for k in first)))
        return found

    def _spelled_again(self, words: pa.Array, *places: np.ndarray) -> np.ndarray:
        """Whether the tokens of both sides give each word's bytes."""
        buf, offsets = textnum.buffers(words)
        right = np.ones(len(words), bool)
        for vocabulary, side, own in zip((self.bytes_a, self.bytes_b), self.sides, places):
            sizes, ids = side.ids(own)
            upto = np.append(0, np.cumsum(vocabulary.sizes[ids]))[np.append(0, np.cumsum(sizes))]
            same = np.flatnonzero(np.diff(upto) == np.diff(offsets))
            lengths = np.diff(offsets)[same]
            spelled = vocabulary.spelled(ids)
            differs = spelled[tokens.ragged(upto[same], lengths)] != buf[tokens.ragged(offsets[same], lengths)]
            as_given = np.zeros(len(words), bool)
            as_given[same] = np.diff(np.append(0, np.cumsum(differs))[np.append(0, np.cumsum(lengths))]) == 0
            right &= as_given
        return right


def _coder(a_path: str, b_path: str) -> PairCoder:
    if (a_path, b_path) not in _coders:
        _coders[a_path, b_path] = PairCoder(a_path, b_path)
    return _coders[a_path, b_path]


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The texts' bytes with a blank before each that isn't empty, the rows' bounds in words, and the words."""
    buf, offsets = textnum.buffers(column)
    some = np.diff(offsets) > 0
    bytes_ = np.insert(buf, offsets[:-1][some], 0x20)
    bounds = offsets + np.append(0, np.cumsum(some))
    starts = tokens.piece_starts(bytes_, bounds[:-1][some])
    inner = bytes_[starts] == 0x20
    # A single blank at a text's end stays with the word before it: alone it would be taken for the one that B adds.
    last = np.isin(starts + 1, bounds[1:]) & ~np.isin(starts, bounds[:-1])
    starts = starts[inner & ~last]
    kind = (pa.int32(), pa.string()) if len(bytes_) < 1 << 31 else (pa.int64(), pa.large_string())
    words = pa.Array.from_buffers(kind[1], len(starts), [None, pa.array(np.append(starts, len(bytes_)), kind[0]).buffers()[1], pa.py_buffer(bytes_)])
    return bounds, np.searchsorted(starts, bounds, "left"), words


def _numerals(ids: np.ndarray, marks: np.ndarray, out_bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal numbers, each followed by its mark (0: none), as bytes; and the rows' bounds in them."""
    digits = np.ones(len(ids), np.int64)
    for power in range(1, 10):
        digits += ids >= 10**power
    ends = np.cumsum(digits + (marks > 0))
    begins = ends - digits - (marks > 0)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    left, place, some = ids.astype(np.int64), begins + digits - 1, np.arange(len(ids))
    while len(some):
        out[place] = left % 10 + 48
        left //= 10
        more = left > 0
        left, place = left[more], place[more] - 1
        some = some[more]
    out[ends[marks > 0] - 1] = marks[marks > 0]
    return out, np.append(0, ends)[out_bounds]


def _row_numbers(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


class Aligned:
    """Tokens, groups and links of a column of texts."""

    def __init__(self, column: pa.Array, own: PairCoder) -> None:
        rows = len(column)
        bounds, word_bounds, words = _words(column)
        coded = words.dictionary_encode()
        places = own.known(coded.dictionary.cast(pa.string()))[coded.indices.to_numpy()]
        of_word = _row_numbers(word_bounds)
        wrong = np.bincount(of_word[~own.right[places]], minlength=rows) > 0
        (size_a, ids_a), (size_b, ids_b) = (side.ids(places) for side in own.sides)
        row_a, row_b = np.repeat(of_word, size_a), np.repeat(of_word, size_b)
        if wrong.any():
            # A word that isn't spelled again: the row has tokens only if the whole is.
            text = np.frombuffer(words.buffers()[2], np.uint8)
            for row in np.flatnonzero(wrong):
                whole = text[bounds[row] : bounds[row + 1]].tobytes()
                wrong[row] = any(v.spelled(i[r == row]).tobytes() != whole for v, i, r in ((own.bytes_a, ids_a, row_a), (own.bytes_b, ids_b, row_b)))
            keep_a, keep_b = ~wrong[row_a], ~wrong[row_b]
            ids_a, row_a, ids_b, row_b = ids_a[keep_a], row_a[keep_a], ids_b[keep_b], row_b[keep_b]
        self.n_a, self.n_b = np.bincount(row_a, minlength=rows), np.bincount(row_b, minlength=rows)
        end_a, end_b = np.cumsum(own.bytes_a.sizes[ids_a]), np.cumsum(own.bytes_b.sizes[ids_b])
        total = int(end_a[-1]) if len(end_a) else 0
        at_a, at_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        at_a[end_a], at_b[end_b] = True, True
        # Between two ends, of whichever side, lies the overlap of one token of A and one of B: each is a link.
        edges = np.flatnonzero(at_a | at_b)
        by_a, by_b = at_a[edges], at_b[edges]
        self.link_a, self.link_b = np.cumsum(by_a) - by_a, np.cumsum(by_b) - by_b
        self.link_row = row_a[self.link_a]
        self.n_links = np.bincount(self.link_row, minlength=rows)
        shared = by_a & by_b
        self.n_groups = np.bincount(self.link_row[shared], minlength=rows)
        self.last_a, self.last_b = self.link_a[shared], self.link_b[shared]  # of each group
        self.ids_a, self.ids_b = ids_a, ids_b
        self.link_a, self.link_b = ids_a[self.link_a], ids_b[self.link_b]

    def groups(self) -> pa.Array:
        """``a1,a2|b1;a3|b2,b3`` for every row."""
        size_a, size_b = np.diff(self.last_a, prepend=-1), np.diff(self.last_b, prepend=-1)
        before_b, upto_a = np.cumsum(size_b) - size_b, np.cumsum(size_a)
        place_a = np.arange(len(self.ids_a)) + np.repeat(before_b, size_a)
        place_b = np.arange(len(self.ids_b)) + np.repeat(upto_a, size_b)
        ids, marks = np.empty(len(place_a) + len(place_b), np.int64), np.full(len(place_a) + len(place_b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = self.ids_a, self.ids_b
        marks[place_a[self.last_a]], marks[place_b[self.last_b]] = ord("|"), ord(";")
        bounds = np.append(0, np.cumsum(self.n_a + self.n_b))
        some = self.n_groups > 0
        marks[bounds[1:][some] - 1] = 0
        flat, offsets = _numerals(ids, marks, bounds)
        return pa.Array.from_buffers(pa.large_string(), len(self.n_a), [None, pa.array(offsets, pa.int64()).buffers()[1], pa.py_buffer(flat)]).cast(pa.string())


def _postings(block: int, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """A block's links by id of B: ids of A, and for each the documents and how often, ascending."""
    width = int(a.max(initial=0)) + 1
    key, n = np.unique((b.astype(np.int64) * width + a) * BLOCK_DOCS + row, return_counts=True)
    pair, first = np.unique(key // BLOCK_DOCS, return_index=True)
    side, begin = np.unique(pair // width, return_index=True)
    ends = np.append(first[1:], len(key))  # of each pair's postings, counted from their block's first
    bounds = np.append(begin, len(pair))
    of_side = np.append(first[begin], len(key))
    ends = ends - np.repeat(of_side[:-1], np.diff(bounds))
    pair_bounds, post_bounds = pa.array(bounds, pa.int32()), pa.array(of_side, pa.int32())
    lists = [
        pa.ListArray.from_arrays(pair_bounds, pa.array((pair % width).astype(np.int32))),
        pa.ListArray.from_arrays(pair_bounds, pa.array(ends.astype(np.int32))),
        pa.ListArray.from_arrays(post_bounds, pa.array((key % BLOCK_DOCS).astype(np.int16))),
        pa.ListArray.from_arrays(post_bounds, pa.array(n.astype(np.int32))),
    ]
    return pa.RecordBatch.from_arrays([pa.array(side.astype(np.int32)), pa.array(np.full(len(side), block, np.int64)), *lists], names=[c.split(" ")[0] for c in POSTINGS.split(", ")])


def alignments(df: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """Documents (``b`` is null) with n_a, n_b, n_groups, n_links, groups and their place (block, doc_at); and postings (the other columns null)."""
    df, names = tables.set_aside(tables.small_batches(df), RESULTS + ("doc_at",) + tuple(c.split(" ")[0] for c in POSTINGS.split(", ")))
    column = names[text]
    kept = [c for c in df.columns if c != column]
    own = df.select(F.col(f"`{column}`").alias("_text"), *[F.col(f"`{c}`") for c in kept])
    added = "n_a long, n_b long, n_groups long, n_links long, groups string, doc_at int, " + POSTINGS
    schema = own.select(*[F.col(f"`{c}`") for c in kept], *[F.lit(None).cast(c.split(" ", 1)[1]).alias(c.split(" ")[0]) for c in added.split(", ")]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        context, pair = TaskContext.get(), _coder(a_path, b_path)
        block = (context.partitionId() if context else 0) << 32
        links: list[tuple[np.ndarray, ...]] = []
        docs = held = 0

        def filled(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in arrow], schema=arrow)

        def postings() -> Iterator[pa.RecordBatch]:
            found = _postings(block, *(np.concatenate(x) for x in zip(*links)))
            step = 4096  # rows at a time
            for i in range(0, len(found), step):
                part = found.slice(i, step)
                yield filled(dict(zip(part.schema.names, part.columns)), len(part))

        for batch in batches:
            for first, column_ in textnum.byte_slices(batch.column(0), GROUP_BYTES):
                for begin in range(0, len(column_), BLOCK_DOCS // 2):
                    texts = column_.slice(begin, BLOCK_DOCS // 2)
                    if docs + len(texts) > BLOCK_DOCS or held > BLOCK_LINKS:
                        if held:
                            yield from postings()
                        links, docs, held, block = [], 0, 0, block + 1
                    found = Aligned(texts, pair)
                    given = batch.slice(first + begin, len(texts))
                    columns = dict(zip(kept, given.columns[1:]))
                    columns |= {c: pa.array(getattr(found, c)) for c in ("n_a", "n_b", "n_groups", "n_links")} | {"groups": found.groups()}
                    columns |= {"block": pa.array(np.full(len(texts), block)), "doc_at": pa.array(np.arange(docs, docs + len(texts), dtype=np.int32))}
                    yield filled(columns, len(texts))
                    links.append((found.link_row + docs, found.link_a, found.link_b))
                    docs, held = docs + len(texts), held + len(found.link_row)
        if held:
            yield from postings()
        tokens.give_back()

    return own.mapInArrow(run, schema)


def _pair_counts(postings: DataFrame) -> DataFrame:
    """(b, a, total) of every pair, added up a batch at a time before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, a, ends, n = batch.columns
            pairs, posts = (x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, n))
            upto = ends.flatten().to_numpy() + np.repeat(np.cumsum(posts) - posts, pairs)  # where each pair's postings end
            total = np.diff(np.append(0, np.cumsum(n.flatten().to_numpy()))[np.append(0, upto)])
            key, where = np.unique(np.repeat(b.to_numpy().astype(np.int64), pairs) << 32 | a.flatten().to_numpy(), return_inverse=True)
            sums = np.zeros(len(key), np.int64)
            np.add.at(sums, where, total)
            yield pa.RecordBatch.from_arrays([pa.array((key >> 32).astype(np.int32)), pa.array((key & 0xFFFFFFFF).astype(np.int32)), pa.array(sums)], names=["b", "a", "total"])

    return postings.select("b", "a", "ends", "n").mapInArrow(run, "b int, a int, total long").groupBy("b", "a").agg(F.sum("total").alias("total"))


class _Sums:
    """Contributions of some ids of B to the documents of some blocks."""

    def __init__(self) -> None:
        self.blocks: dict[int, np.ndarray] = {}

    def add(self, block: int, at: np.ndarray, best: np.ndarray, total: np.ndarray) -> None:
        sums, needed = self.blocks.get(block), int(at.max()) + 1
        if sums is None or sums.shape[1] < needed:
            grown = np.zeros((2, max(needed, 0 if sums is None else min(BLOCK_DOCS, 2 * sums.shape[1]))), np.int64)
            if sums is not None:
                grown[:, : sums.shape[1]] = sums
            self.blocks[block] = sums = grown
        np.add.at(sums[0], at, best)
        np.add.at(sums[1], at, total)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for block, sums in self.blocks.items():
            at = np.flatnonzero(sums[1])
            own, begin = np.unique(at // SUM_DOCS, return_index=True)
            bounds = pa.array(np.append(begin, len(at)), pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (at.astype(np.int16), sums[0][at], sums[1][at])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block, np.int64)), pa.array(own.astype(np.int32)), *lists], names=["block", "part", "at", "n_best", "count_sum"])
        self.blocks = {}


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by share and id of B, an id's counts before its postings."""
    sums, share, counted, ids, counts, most = _Sums(), None, None, np.empty(0, np.int32), np.empty(0, np.int64), 0
    for batch in batches:
        for own_share, b, role, block, a, ends, at, n, total in zip(*batch.columns):
            if own_share.as_py() != share:
                yield from sums.rows()
                share = own_share.as_py()
            if role.as_py() == 0:
                counted, ids, counts = b.as_py(), a.values.to_numpy(), total.values.to_numpy()
                most = counts.max()
                continue
            if counted != b.as_py():
                raise ValueError("postings without counts")
            own = counts[np.searchsorted(ids, a.values.to_numpy())]
            each = np.repeat(own, np.diff(ends.values.to_numpy(), prepend=0))
            times = n.values.to_numpy().astype(np.int64)
            sums.add(block.as_py(), at.values.to_numpy(), times * (each == most), times * each)
    yield from sums.rows()


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by block and part; one row for each document that has links."""
    key, sums = None, np.zeros((2, SUM_DOCS), np.int64)

    def row() -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(sums[1])
        if key and len(at):
            columns = [np.full(len(at), key[0], np.int64), (at + key[1] * SUM_DOCS).astype(np.int32), sums[0][at], sums[1][at]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "doc_at", "n_best", "count_sum"])

    for batch in batches:
        for block, part, at, best, total in zip(*batch.columns):
            if key != (block.as_py(), part.as_py()):
                yield from row()
                key, sums = (block.as_py(), part.as_py()), np.zeros((2, SUM_DOCS), np.int64)
            own = at.values.to_numpy() - key[1] * SUM_DOCS
            sums[0][own] += best.values.to_numpy()
            sums[1][own] += total.values.to_numpy()
    yield from row()


def link_scores(aligned: DataFrame, *, sides: int = SIDES, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """The documents of ``alignments`` (with further columns, or fewer), with n_best and count_sum."""
    names = [c.split(" ")[0] for c in POSTINGS.split(", ")]
    scratch = tables.Scratch(aligned.sparkSession, "alignment")
    staged = scratch.stage(aligned, "alignments", ROW_GROUP)
    docs = staged.filter("b IS NULL").drop(*[c for c in names if c != "block"])
    postings = staged.filter("b IS NOT NULL").select(*names)
    pairs = F.array_sort(F.collect_list(F.struct("a", "total")))  # as many as A has ids at most
    counts = scratch.stage(_pair_counts(postings).groupBy("b").agg(pairs.alias("pairs")), "counts", ROW_GROUP)
    groups = max(1, -(-docs.select("block").distinct().count() // group_blocks))
    # An id's postings are dealt by groups of blocks, each with the id's counts.
    share = lambda group: (group * sides + F.pmod(F.xxhash64("b"), F.lit(sides))).alias("share")
    nothing = {c: F.lit(None).cast(t).alias(c) for c, t in (("block", "long"), ("ends", "array<int>"), ("at", "array<smallint>"), ("n", "array<int>"), ("total", "array<bigint>"))}
    first = counts.select("b", "pairs", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    first = first.select(share(F.col("group")), "b", F.lit(0).alias("role"), nothing["block"], F.col("pairs.a").alias("a"), nothing["ends"], nothing["at"], nothing["n"], F.col("pairs.total").alias("total"))
    dealt = postings.select(share(F.pmod(F.xxhash64("block"), F.lit(groups))), "b", F.lit(1).alias("role"), "block", "a", "ends", "at", "n", nothing["total"])
    stream = first.union(dealt).repartition("share").sortWithinPartitions("share", "b", "role")
    given = stream.mapInArrow(_contributions, "block long, part int, at array<smallint>, n_best array<bigint>, count_sum array<bigint>")
    sums = given.repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(_added_up, "block long, doc_at int, n_best long, count_sum long")
    scored = docs.join(sums, ["block", "doc_at"], "left").drop("block", "doc_at")
    return scored.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})
