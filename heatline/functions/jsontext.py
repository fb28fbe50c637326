"""JSON inside free text, and canonical JSON: the two steps that need a parser of their own."""

from __future__ import annotations

import bisect
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OPEN, _CLOSE = re.compile(r"```(?:json)?\s*(?=\{)", re.I), re.compile(r"\}\s*```")


def _loaded(text: str) -> object:
    """The JSON value of a whole text; None for anything else, and for null."""
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def _fenced(text: str) -> list[dict]:
    """The objects that stand alone in a fence; fences with anything else don't count."""
    closes = [m.start() + 1 for m in _CLOSE.finditer(text)]
    found, at = [], 0
    while m := _OPEN.search(text, at):
        k = bisect.bisect_right(closes, m.end())
        if k == len(closes):
            break
        value = _loaded(text[m.end() : closes[k]])
        found += [value] if isinstance(value, dict) else []
        at = text.index("```", closes[k]) + 3
    return found


def _embedded(text: str) -> list[dict]:
    """The objects anywhere in a text, none of them inside another."""
    decoder, at, found = json.JSONDecoder(), 0, []
    while (at := text.find("{", at)) >= 0 and len(found) < 2:
        try:
            value, at = decoder.raw_decode(text, at)
            found.append(value)
        except (ValueError, RecursionError):
            at += 1
    return found


def single_object(text: str | None) -> tuple[str | None, str]:
    """(canonical JSON, how it was found): direct, fenced or embedded; else None with empty, invalid or ambiguous.

    A text that is a JSON value of another kind is invalid.  One object in fences wins
    over objects elsewhere; two of a kind are ambiguous.  Texts with very many braces
    that open nothing take time in proportion to their number and the text's length.
    """
    text = (text or "").strip()
    if not text:
        return None, "empty"
    whole = _loaded(text)
    if whole is not None:
        return (canonical(whole), "direct") if isinstance(whole, dict) else (None, "invalid")
    for name, find in (("fenced", _fenced), ("embedded", _embedded)):
        if found := find(text):
            return (canonical(found[0]), name) if len(found) == 1 else (None, "ambiguous")
    return None, "invalid"


def canonical(value: object) -> str:
    """Sorted keys, no spaces."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def contract_hash(text: str | None, without: str = "contract_hash") -> str | None:
    """SHA-256 of an object's canonical form without its own hash field; None for anything else."""
    try:
        value = json.loads(text or "")
    except ValueError:
        return None
    if not isinstance(value, dict):
        return None
    return hashlib.sha256(canonical({k: v for k, v in value.items() if k != without}).encode()).hexdigest()


def extracted(text: Column) -> Column:
    """struct(json, status) of the one object in each text."""

    @F.arrow_udf("struct<json:string,status:string>")
    def run(column: pa.Array) -> pa.Array:
        found = [single_object(t) for t in column.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], ["json", "status"])

    return run(text)


def hashed(text: Column) -> Column:
    @F.arrow_udf(T.StringType())
    def run(column: pa.Array) -> pa.Array:
        return pa.array([contract_hash(t) for t in column.to_pylist()], pa.string())

    return run(text)


def check(op: Column, actual: Column, expected: Column, absolute: Column, relative: Column) -> Column:
    """One numeric check: equal, approx or less_equal; null actual fails."""
    close = F.abs(actual - expected) <= F.greatest(relative * F.greatest(F.abs(actual), F.abs(expected)), absolute)
    passed = F.when(op == "equal", actual == expected).when(op == "approx", close).when(op == "less_equal", actual <= expected + absolute)
    return F.coalesce(passed, F.lit(False))


def normalised_error(actual: Column, expected: Column) -> Column:
    return F.abs(actual - expected) / F.greatest(F.abs(expected), F.lit(1e-12))
