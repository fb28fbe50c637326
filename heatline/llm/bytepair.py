r"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

A rank file has a token's bytes in base64 and its rank in every line.  The library
splits a text by ``pattern`` and merges each match separately; special tokens aren't
known to it here, so their strings inside texts are ordinary text.

Texts of more than ``LONG`` characters are split before they are encoded, at
boundaries that no match of the pattern crosses: in front of a blank behind an ASCII
letter, digit or mark.  A run of white space of more than ``LONG`` characters, which
the library's matcher can't hold, is one match but for its last character (or wholly,
at the end of a text), and is merged as such.  So the ids are those of the whole text.

Null and empty texts have no ids.  Repeated rows are encoded each for itself.  Decoding
gives raw bytes, which need not be UTF-8 for ids cut out of a text; null ids count as
none, and an unknown id raises an error.  An input column named as the result keeps its
values under that name with ``_in`` behind it; all others pass through.  A task holds
the ids of about ``GROUP_BYTES`` of text at a time, or those of one longer text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tables

#: Characters of a text, and of a run of white space, beyond which it is split; bytes of text encoded at a time; ids decoded at a time.
LONG, GROUP_BYTES, IDS_AT_ONCE = 1 << 16, 2 << 20, 1 << 18

#: Fixed value: what the library's pattern takes for white space.
WHITE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Column of ``with_ids``.
RESULTS = ("bpe_ids",)

_boundary = re.compile(r"(?<=[!-~])(?= )")
_codings: dict[tuple[str, str], object] = {}


def coding(path: str, pattern: str):
    """The library's coding of a rank file, one for each Python worker."""
    if (path, pattern) not in _codings:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
        _codings[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _codings[path, pattern]


def parts(text: str, long: int = LONG) -> Iterator[tuple[str, bool]]:
    """A text in order, in parts that can be encoded separately, and whether a part is one match of the pattern."""
    begin = 0
    for run in [*re.finditer(f"[{WHITE_SPACE}]{{{long + 1},}}", text), None]:
        end = run.start() if run else len(text)
        while begin < end:
            cut = _boundary.search(text, begin + long, end)
            stop = cut.start() if cut else end
            yield text[begin:stop], False
            begin = stop
        if run:
            begin = run.end() if run.end() == len(text) else run.end() - 1
            yield text[end:begin], True


def encode(text: str, own, long: int = LONG) -> list[int]:
    """The ids of a whole text."""
    if len(text) <= long:
        return own.encode_ordinary(text)
    ids: list[int] = []
    for part, single in parts(text, long):
        ids += own._encode_single_piece(part) if single else own.encode_ordinary(part)
    return ids


def _lists(rows: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.fromiter((i for ids in rows for i in ids), np.int32, ends[-1])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def encoded(text: Column | str, path: str, pattern: str) -> Column:
    """Column: the ids of ``text`` by the rank file at ``path``, as array<int>."""

    @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
    def ids(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = coding(path, pattern)
        for column in columns:
            sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            group = np.cumsum(sizes) // GROUP_BYTES
            cuts = np.flatnonzero(np.diff(group)) + 1
            bounds = [0, *cuts.tolist(), len(column)]
            yield pa.concat_arrays([_lists([encode(t or "", own) for t in column.slice(a, b - a).to_pylist()]) for a, b in zip(bounds, bounds[1:])])

    return ids(text)


def decoded(ids: Column | str, path: str, pattern: str) -> Column:
    """Column: the bytes of ``ids``, as binary."""

    @F.arrow_udf(T.BinaryType())
    def raw(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = coding(path, pattern)
        for column in columns:
            out = []
            for row in column:
                held = row.values.to_numpy(zero_copy_only=False) if row.is_valid else np.empty(0, np.int32)
                out.append(b"".join(own.decode_bytes(held[i : i + IDS_AT_ONCE].tolist()) for i in range(0, len(held), IDS_AT_ONCE)))
            yield pa.array(out, pa.binary())

    return raw(ids)


def ids_digest(ids: Column | str) -> Column:
    """Column: SHA-256 (lower-case hex) of decimal ids joined by commas, taken in blocks, so that no long text of ids is built."""

    @F.arrow_udf(T.StringType())
    def digest(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import hashlib

        for column in columns:
            out = []
            for row in column:
                held, sum_ = row.values.to_numpy(zero_copy_only=False) if row.is_valid else np.empty(0, np.int32), hashlib.sha256()
                for i in range(0, len(held), IDS_AT_ONCE):
                    sum_.update((("," if i else "") + ",".join(map(str, held[i : i + IDS_AT_ONCE].tolist()))).encode())
                out.append(sum_.hexdigest())
            yield pa.array(out, pa.string())

    return digest(ids)


def with_ids(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``bpe_ids``, the ids of ``text``."""
    df, names = tables.set_aside(tables.small_batches(df), RESULTS)
    return df.withColumn("bpe_ids", encoded(F.col(f"`{names[text]}`"), path, pattern))
