"""Loss spans of templates other than the own one."""

import pytest

from heatline.llm import chat

TURNS = [("user", "a"), ("assistant", "a"), ("user", "x"), ("assistant", "  b & c\n"), ("assistant", "")]


def render(spark, template, turns=TURNS):
    df = spark.createDataFrame([(1, k, *t) for k, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    return chat.format_conversations(df, template=template).collect()[0]


def learned(r):
    return [r["formatted"][a:b] for a, b in zip(r["loss_starts"], r["loss_ends"], strict=True)]


plain = lambda own: "".join(f"<{r}>{t}</{r}>" for r, t in own)  # noqa: E731 (sent to tasks by value)


@pytest.mark.parametrize(
    "template, want",
    [
        (plain, ["a", "  b & c\n", ""]),
        (lambda own: "".join(f"[{r}] {t.strip()};" for r, t in own), ["a", "b & c", ""]),
        (lambda own: "".join(f"[{r}] {t.replace('&', '&amp;')};" for r, t in own), ["a", "  b &amp; c\n", ""]),
        (lambda own: plain(own).upper(), ["A", "  B & C\n", ""]),
        (lambda own: f"{len(own)} turns of assistant:" + plain(own), ["a", "  b & c\n", ""]),
        (lambda own: "=" * 50 * len(own) + plain(own), ["a", "  b & c\n", ""]),
    ],
)
def test_texts_are_learned_as_the_template_wrote_them(spark, template, want):
    r = render(spark, template)
    assert learned(r) == want and r["unlocated"] == []
    for k, (a, b) in enumerate(zip(r["loss_starts"], r["loss_ends"], strict=True)):
        turn = (1, 3, 4)[k]
        assert r["turn_starts"][turn] <= a <= b <= r["turn_ends"][turn]


def test_spans_of_a_template_that_rewrites_follow_its_last_output():
    template = lambda own: f"{len(own)}!" * len(own) + plain(own)
    text, spans, rewrites = chat.turn_spans(TURNS, template)
    assert rewrites and [text[a:b] for a, b in spans] == ["5!" * 5 + plain(TURNS[:1]), *[plain([t]) for t in TURNS[1:]]]


def test_texts_without_a_known_place_are_flagged(spark):
    last = lambda own: "".join(f"<{r}>{t if k == len(own) - 1 else '...'}" for k, (r, t) in enumerate(own))
    r = render(spark, last)
    assert r["rewrites"] and r["unlocated"] == [1, 3] and learned(r) == [""]
    twice = render(spark, lambda own: "".join(f"<{r}>{t}|{t}" for r, t in own))
    assert twice["unlocated"] == [1, 3, 4] and learned(twice) == []
