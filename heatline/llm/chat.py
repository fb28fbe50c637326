r"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to one string.  It
is asked for every successive prefix of a conversation; where an output continues
the one before, the new part is the new turn's span.  A template that changes what
it wrote before is found out (``rewrites``), and all spans are then taken from the
last output, where each turn's text is found and what follows the text ends the turn.
The loss mask covers the assistant texts as the template wrote them, trimmed or
escaped.  A text's place is where the output differs from that of the same turns with
a mark in place of the text.  Where that gives no single place (the template left the
text out, wrote it twice or made other parts depend on it), the turn's index is in
``unlocated`` and its text isn't in the mask.

The own template writes ``### role: text</turn>`` and a line end for each turn
and puts a backslash before every ``\``, ``#`` and ``<`` of a text (in roles also
before ``:``), so control strings inside texts can't be taken for marks and
``unescape`` gives back exactly what was there.

Null roles and texts count as empty, a null conv_id is a conversation of its own.
Turns go by turn, role and text, null first; repeated rows are turns each for
itself.  An empty table gives no conversations.  Cost is quadratic in the turns
of one conversation, since every prefix is rendered; memory is one rendering.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables

Turns = list[tuple[str, str]]
SCHEMA = "conv_id long, n_turns long, formatted string, turn_starts array<long>, turn_ends array<long>, loss_starts array<long>, loss_ends array<long>, rewrites boolean, unlocated array<long>"
END = "</turn>\n"
#: Texts that templates leave as they are; the second for those that change ASCII letters.
MARKS = ("zq7xk9vj", "\ue03f\ue1a7\ue2c5\ue0d9")
_TURN = re.compile(r"### ((?:\\.|[^\\:#<])*): ((?:\\.|[^\\#<])*)</turn>\n", re.S)


def escape(text: str, marks: str = r"\\#<") -> str:
    return re.sub(f"([{marks}])", r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def marked_turns(turns: Turns) -> str:
    """The own template."""
    return "".join(f"### {escape(role, r'\\#<:')}: {escape(text)}{END}" for role, text in turns)


def text_span(turns: Turns, k: int, template: Callable[[Turns], str], formatted: str) -> tuple[int, int] | None:
    """Where the text of turn ``k`` stands in ``formatted``, the rendering of ``turns``; None if that can't be told."""
    for mark in MARKS:
        while mark in formatted:
            mark += mark
        marked = template([*turns[:k], (turns[k][0], mark), *turns[k + 1 :]])
        start = marked.find(mark)
        if start < 0 or marked.find(mark, start + 1) >= 0:
            continue
        after = marked[start + len(mark) :]
        end = len(formatted) - len(after)
        if start <= end and formatted.startswith(marked[:start]) and formatted.endswith(after):
            return start, end
    return None


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def _final_spans(turns: Turns, template: Callable[[Turns], str], formatted: str) -> list[tuple[int, int]]:
    """Spans in the last rendering of a template that rewrites history.

    A turn ends after its text and as much of what follows as also ends the rendering
    that stops with this turn.  Where a text can't be located the span is empty.
    """
    places = [text_span(turns, k, template, formatted) for k in range(len(turns))]
    located = [k for k, place in enumerate(places) if place]
    spans = [(0, 0)] * len(turns)
    start = _common(template([]), formatted[: places[located[0]][0]]) if located else 0
    at = 0
    for k in range(len(turns)):
        if not places[k]:
            spans[k] = (start, start)
            continue
        at += 1
        end = places[k][1]
        if at == len(located):
            end = len(formatted)
        else:
            now = template(turns[: k + 1])
            own = text_span(turns[: k + 1], k, template, now)
            end += _common(now[own[1] :], formatted[end : places[located[at]][0]]) if own else 0
        spans[k], start = (start, end), end
    return spans


def turn_spans(turns: Turns, template: Callable[[Turns], str]) -> tuple[str, list[tuple[int, int]], bool]:
    """The whole rendering, each turn's span in it, and whether the template rewrote history."""
    before, spans, rewrites = template([]), [], False
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        start = len(before)
        if not now.startswith(before):
            rewrites = True
        spans.append((start, len(now)))
        before = now
    return before, _final_spans(turns, template, before) if rewrites else spans, rewrites


def parse_turns(formatted: str, spans: list[tuple[int, int]]) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the escaped text) of every span, read from the output alone."""
    out = []
    for start, end in spans:
        m = _TURN.fullmatch(formatted, start, end)
        if not m:
            raise ValueError(f"span {start}-{end} isn't one marked turn")
        out.append((unescape(m[1]), unescape(m[2]), *m.span(2)))
    return out


def _format(batches: Iterator[pa.RecordBatch], template: Callable[[Turns], str], learn: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """Rows come by conversation and turn; one conversation is held at a time."""
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
    number = pa.list_(pa.int64())
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), number, number, number, number, pa.bool_(), number], strict=True)))
    held: Turns = []
    key: object = held  # no conversation yet
    rows: list[dict] = []
    size = 0

    def close() -> int:
        formatted, spans, rewrites = turn_spans(held, template)
        loss, unlocated = [], []
        if template is marked_turns:
            loss = [(a, b) for role, _, a, b in parse_turns(formatted, spans) if role in learn]
        else:
            for k, (role, _) in enumerate(held):
                if role in learn:
                    place = text_span(held, k, template, formatted)
                    loss += [place] if place else []
                    unlocated += [] if place else [k]
        values = (key, len(held), formatted, [a for a, _ in spans], [b for _, b in spans], [a for a, _ in loss], [b for _, b in loss], rewrites, unlocated)
        rows.append(dict(zip(names, values, strict=True)))
        return len(formatted)

    for b in batches:
        for conv, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if conv != key or key is held:
                if key is not held:
                    size += close()
                key, held = conv, []
                if size >= 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            held.append((role or "", text or ""))
    if held:
        close()
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def format_conversations(df: DataFrame, *, template: Callable[[Turns], str] = marked_turns, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: the rendering, every turn's span, the spans under the loss mask, ``rewrites``, and the turns to learn from whose text has no known place."""
    order = ["conv_id", F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text")]
    dealt = tables.small_batches(df).select(F.col("conv_id").cast("long"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions(*order)
    return dealt.select("conv_id", "role", "text").mapInArrow(lambda batches: _format(batches, template, frozenset(learn)), SCHEMA)


def read_back(formatted: str, starts: list[int], ends: list[int], loss: list[tuple[int, int]]) -> dict:
    """Digests of what a rendering of the own template holds, read from it."""
    turns = hashlib.sha256()
    for role, text, _, _ in parse_turns(formatted, list(zip(starts, ends, strict=True))):
        turns.update(f"{role}\n{text}\n".encode())
    learned = [unescape(formatted[a:b]) for a, b in loss]
    digest = hashlib.sha256()
    for text in learned:
        digest.update(text.encode())
    return {"turns_sha256": turns.hexdigest(), "loss_chars": sum(map(len, learned)), "loss_sha256": digest.hexdigest(), "formatted_chars": len(formatted)}


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of rendered conversations."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                read = read_back(r["formatted"], r["turn_starts"], r["turn_ends"], list(zip(r["loss_starts"], r["loss_ends"], strict=True)))
                rows.append({"conv_id": r["conv_id"], "n_turns": r["n_turns"], **read})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
