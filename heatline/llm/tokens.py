"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut into pieces, each a run of white space and what stands behind it,
which no pre-token of the supported vocabularies crosses.  Equal pieces of a group
of about ``GROUP_BYTES`` are encoded once, a worker remembers pieces of the groups
before, and what is sent to the tokenizer goes in batches of about equal bytes.
A very long text goes through several groups.

How far a piece may be taken apart is read from the vocabulary file
(``PieceCoder.rules``); a vocabulary of another kind gets every text whole.

Null and empty texts have no tokens.  Repeated rows are counted each for itself.
Other columns pass through; one that is named as a result keeps its values under
that name with ``_in`` behind it.
"""

from __future__ import annotations

import ctypes
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tables, textnum

#: Bytes of one call of the tokenizer, and of the text whose pieces are held at a time.
ENCODE_BYTES, GROUP_BYTES = 1 << 16, 2 << 20
#: Pieces that a Python worker remembers, their bytes of text, and the longest of them.
KNOWN_PIECES, KNOWN_BYTES, KNOWN_LENGTH = 500_000, 8 << 20, 64
#: Words that are joined for one encoding.
JOINED = 128

#: Columns of ``with_token_counts``.
RESULTS = ("n_bytes", "n_tokens", "over_limit")

#: How the two supported vocabularies state that they cut texts.
_LOWER_CASE = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_SPACES = " \t\n\v\f\r"
#: Marks that are pre-tokens of their own behind a word, in both vocabularies.
_MARKS = ".,;:!?%&*#$"
#: Latin letters that every Unicode version has, as one character with one lower-case form.
_LETTERS = "".join(c for c in map(chr, range(0x41, 0x250)) if c.isalpha() and len(c.lower()) == 1 and ord(c.lower()) < 0x250)

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(map(ord, _SPACES))] = True
_coders: dict[tuple[str, bool], "PieceCoder"] = {}


def _after_wide_space(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a white-space character beyond ASCII ends just before each position."""
    one, two, three = (buf[np.maximum(at - k, 0)] for k in (1, 2, 3))
    general = (three == 0xE2) & ((two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF)) | (two == 0x81) & (one == 0x9F))
    return (two == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (three == 0xE1) & (two == 0x9A) & (one == 0x80) | (three == 0xE3) & (two == 0x80) & (one == 0x80) | general


def piece_starts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin: at texts, and at white space behind something else."""
    if not len(buf):
        return np.empty(0, np.int64)
    space = _IS_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    np.greater(space[1:], space[:-1], out=edge[1:-1])
    at = np.flatnonzero(edge[:-1])
    at = at[buf[at - 1] >= 0x80]
    edge[at[_after_wide_space(buf, at)]] = False
    edge[offsets] = True
    return np.flatnonzero(edge[:-1])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + lengths[i] - 1 of all i, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 31 and starts.max(initial=0) < 1 << 30 else np.int64
    out = np.repeat((starts - ends + lengths).astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out


class PieceCoder:
    """Encodes pieces of text with one tokenizer, remembering those met last."""

    def __init__(self, path: str, with_ids: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.with_ids = with_ids
        self.kind = self.rules()
        if self.kind:
            # A word begins, or ends, with one token that no other place of a word can hold.
            suffix = self.tokenizer.model.end_of_word_suffix
            vocabulary = (self.tokenizer.id_to_token(i) or " " for i in range(self.tokenizer.get_vocab_size()))
            self.edge = np.fromiter((t.endswith(suffix) if suffix else t[0] in "ĠĊ" for t in vocabulary), bool)
        self.joined = self.tokenizer
        if self.kind == "lower":
            # Lower-case words without marks need neither the normaliser nor the pattern.
            from tokenizers import pre_tokenizers

            self.joined = Tokenizer(self.tokenizer.model)
            self.joined.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.forget()

    def rules(self) -> str | None:
        """``lower``: white space is dropped and letters are lower-cased; ``bytes``: all bytes count; None: neither is sure."""
        own, model = self.tokenizer, self.tokenizer.model
        plain = all(not (t.lstrip or t.rstrip or t.single_word or t.normalized) and not set(t.content) & set(_SPACES) for t in own.get_added_tokens_decoder().values())
        if type(model).__name__ != "BPE" or model.dropout or model.continuing_subword_prefix or not plain:
            return None
        normal = json.loads(own.normalizer.__getstate__()) if own.normalizer else None
        pre = json.loads(own.pre_tokenizer.__getstate__()) if own.pre_tokenizer else {}
        if normal is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not model.end_of_word_suffix:
            return "bytes"
        steps = pre.get("pretokenizers", [])
        if (normal or {}).get("normalizers") == _LOWER_CASE and [s["type"] for s in steps] == ["Split", "ByteLevel"] and model.end_of_word_suffix:
            split, level = steps
            if split["pattern"] == {"Regex": _WORD_PATTERN} and split["invert"] and split["behavior"] == "Removed" and not level["use_regex"] and not level["add_prefix_space"]:
                return "lower"
        return None

    def forget(self) -> None:
        """Nothing is remembered, as at the start."""
        self.known = pa.array([], pa.string())
        self.sizes, self.used = np.empty(0, np.int32), np.empty(0, np.int32)
        self.flat, self.round = np.empty(0, np.uint32), 0

    def _trim(self) -> None:
        """Of a memory that is too full, the half met last stays."""
        if len(self.known) > KNOWN_PIECES or self.known.nbytes > KNOWN_BYTES:
            order = np.argsort(-self.used, kind="stable")[: KNOWN_PIECES // 2]
            bytes_kept = np.cumsum(pc.binary_length(self.known).to_numpy()[order])
            kept = np.sort(order[bytes_kept <= KNOWN_BYTES // 2])
            if self.with_ids:
                self.flat = self.flat[ragged((np.cumsum(self.sizes) - self.sizes)[kept], self.sizes[kept])]
            self.known, self.sizes, self.used = self.known.take(pa.array(kept)), self.sizes[kept], self.used[kept]

    def parts(self, distinct: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """What each piece is encoded as: a core, whether that is a simple word, and marks behind it."""
        body = pc.utf8_trim(distinct, characters=_SPACES) if self.kind == "lower" else distinct
        core = pc.utf8_rtrim(body, characters=_MARKS)
        white = "" if self.kind == "lower" else "[ \n]"
        simple = pc.match_substring_regex(core, f"^{white}[{_LETTERS}]+$")
        marks = pc.if_else(simple, pc.utf8_ltrim(body, characters=_LETTERS + _SPACES), "")
        if self.kind == "lower":
            core = pc.utf8_lower(core)
        return pc.if_else(simple, core, body), simple, marks

    def _encoded(self, texts: list[str], joined: bool) -> Iterator[np.ndarray]:
        """Ids of texts in order, asked for in batches balanced by bytes; joined texts come as one."""
        own = self.joined if joined else self.tokenizer
        batch, size = [], 0
        for t in [*texts, None]:
            if t is None or size >= ENCODE_BYTES:
                for e in own.encode_batch_fast(batch, add_special_tokens=False):
                    yield np.array(e.ids, np.uint32)
                batch, size = [], 0
            batch.append(t)
            size += len(t or "") + 8

    def _learn(self, pieces: pa.Array, simple: np.ndarray) -> None:
        """Adds pieces to what is known; simple words are encoded together and cut apart at their edges."""
        words, others = pieces.filter(pa.array(simple)).to_pylist(), pieces.filter(pa.array(~simple)).to_pylist()
        between = " " if self.kind == "lower" else ""
        sizes, flat = np.empty(len(pieces), np.int32), []
        if words:
            ids = np.concatenate(list(self._encoded([between.join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)], True)))
            at = np.flatnonzero(self.edge[ids])
            bounds = np.append(at, len(ids)) if between == "" else np.append(0, at + 1)
            if len(bounds) != len(words) + 1 or bounds[0] or bounds[-1] != len(ids):
                raise ValueError("the vocabulary's word edges don't fit its words")
            sizes[: len(words)] = np.diff(bounds)
            flat.append(ids)
        for k, ids in enumerate(self._encoded(others, False)):
            sizes[len(words) + k] = len(ids)
            flat.append(ids)
        self.known = pa.concat_arrays([self.known, pa.array(words + others, pa.string())])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.used = np.concatenate([self.used, np.full(len(pieces), self.round, np.int32)])
        if self.with_ids:
            self.flat = np.concatenate([self.flat, *flat])

    def codes(self, pieces: pa.Array, simple: np.ndarray) -> np.ndarray:
        """The place of every piece in what is known; unknown ones are learned."""
        found = pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy().copy()
        new = found < 0
        if new.any():
            first = len(self.known)
            self._learn(pieces.filter(pa.array(new)), simple[new])
            words = np.flatnonzero(new & simple)  # they were learned first
            found[words] = first + np.arange(len(words))
            found[new & ~simple] = np.arange(first + len(words), len(self.known))
        self.used[found] = self.round
        return found

    def encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray | None]:
        """The number of ids of every piece, and all ids one after the other (or None, where lengths only are asked for)."""
        self.round += 1
        self._trim()
        pieces = pieces.dictionary_encode()
        at = pieces.indices.to_numpy()
        core, simple, marks = self.parts(pieces.dictionary)
        keys = pa.concat_arrays([core, marks]).dictionary_encode()
        kinds = np.zeros(len(keys.dictionary), bool)
        own = keys.indices.to_numpy()
        kinds[own[: len(core)][simple.to_numpy(zero_copy_only=False)]] = True
        both = self.codes(keys.dictionary, kinds)[own].reshape(2, -1)  # core above marks
        sizes = self.sizes[both].astype(np.int64)
        lengths = sizes.sum(0)[at]
        if not self.with_ids:
            out = None
        else:
            starts = (np.cumsum(self.sizes, dtype=np.int64) - self.sizes)[both]
            own_ids = self.flat[ragged(starts.T.ravel(), sizes.T.ravel())]
            out = own_ids[ragged((np.cumsum(sizes.sum(0)) - sizes.sum(0))[at], lengths)]
        self._drop_long()
        pa.default_memory_pool().release_unused()
        return lengths, out

    def _drop_long(self) -> None:
        """Pieces beyond ``KNOWN_LENGTH`` aren't remembered."""
        short = pc.binary_length(self.known).to_numpy() <= KNOWN_LENGTH
        if not short.all():
            if self.with_ids:
                self.flat = self.flat[np.repeat(short, self.sizes)]
            self.known, self.sizes, self.used = self.known.filter(pa.array(short)), self.sizes[short], self.used[short]


def give_back() -> None:
    """Hands memory that is free in this Python worker to the system; others share the executor's."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def release() -> None:
    """Empties what this Python worker remembers; tasks of other operators may follow in it."""
    _coders.clear()
    give_back()


def coder(path: str, with_ids: bool) -> PieceCoder:
    """One coder for each vocabulary and Python worker."""
    if (path, with_ids) not in _coders:
        _coders[path, with_ids] = PieceCoder(path, with_ids)
    return _coders[path, with_ids]


def _grouped(buf: np.ndarray, offsets: np.ndarray, whole: bool) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(row of each piece, pieces) in groups of about ``GROUP_BYTES``; ``whole``: a piece is a whole text."""
    starts = piece_starts(buf, offsets) if not whole else offsets[:-1][np.diff(offsets) > 0]
    ends = np.append(starts[1:], len(buf))
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + GROUP_BYTES, "right")))
        low, high = starts[i], ends[j - 1]
        cuts = np.append(starts[i:j], high) - low
        rows = np.searchsorted(offsets, starts[i:j], "right") - 1
        kind = (pa.int32(), pa.string()) if high - low < 1 << 31 else (pa.int64(), pa.large_string())
        pieces = pa.Array.from_buffers(kind[1], j - i, [None, pa.array(cuts, kind[0]).buffers()[1], pa.py_buffer(buf[low:high])])
        yield rows, pieces
        i = j


def encode_column(column: pa.Array, path: str, with_ids: bool, end: int | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """The number of ids of every text, and all ids one after the other; ``end`` is put behind each text if given."""
    own = coder(path, with_ids)
    buf, offsets = textnum.buffers(column)
    counts, flat = np.zeros(len(column), np.int64), []
    for rows, pieces in _grouped(buf, offsets, not own.kind):
        if own.kind and pieces.type == pa.string():
            lengths, ids = own.encode(pieces)
        else:
            each = list(own._encoded(pieces.to_pylist(), False))
            lengths, ids = np.array([len(x) for x in each], np.int64), np.concatenate(each) if with_ids else None
        counts += np.bincount(rows, lengths, len(column)).astype(np.int64)
        flat.append(ids)
    if not with_ids:
        return counts + (end is not None), None
    ids = np.concatenate(flat) if flat else np.empty(0, np.uint32)
    if end is None:
        return counts, ids
    counts += 1
    out = np.full(counts.sum(), end, np.uint32)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(counts) - 1] = False
    out[inside] = ids
    return counts, out


def token_count(text: Column | str, path: str) -> Column:
    """Column: the tokens of ``text`` as the vocabulary file at ``path`` gives them, without added special tokens."""

    @F.arrow_udf(T.LongType())
    def count(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for held in tables.gathered(columns, GROUP_BYTES):
            counts, i = encode_column(pa.concat_arrays(held), path, False)[0], 0
            for column in held:
                yield pa.array(counts[i : i + len(column)], pa.int64())
                i += len(column)

    return count(text)


def with_token_counts(df: DataFrame, path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """``df`` with n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens)."""
    df, names = tables.set_aside(tables.small_batches(df), RESULTS)
    text = f"`{names[text]}`"
    return (
        df.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
        .withColumn("n_tokens", token_count(F.col(text), path))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
