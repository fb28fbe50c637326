"""Long mixtures and mixtures of many languages."""

import numpy as np
import pyarrow as pa
import pytest

from heatline.llm import language

LETTERS = ["abc", "def", "ghi", "jkl", "mno"]
WORDS = [x + x[::-1] for x in LETTERS]
NAMES = ["l" + x for x in LETTERS]


@pytest.fixture(scope="module")
def table():
    batch = pa.RecordBatch.from_pydict({"t": [f"{w} " * 200 for w in WORDS], "l": NAMES})
    names, found = language.log_table(pa.Table.from_batches(language._count(iter([batch]))))
    assert names == NAMES
    return found


def test_a_long_text_is_a_mixture_as_its_short_form_is(table):
    mixed = f"{WORDS[0]} {WORDS[1]} {WORDS[0]} "
    best, part = language.infer(pa.array([mixed * 1000, mixed * 100_000, None, "ghiihg"], pa.string()), table)
    assert best.tolist() == [0, 0, -1, 2]
    assert part[0] == pytest.approx(2 / 3, abs=0.01) and part[1] == pytest.approx(part[0], abs=0.01)


@pytest.mark.parametrize("n", [4, 5])
def test_sets_grow_beyond_three_languages(table, n):
    text = " ".join([WORDS[1], *WORDS[:n]] * 300)
    best, part = language.infer(pa.array([text]), table)
    assert best[0] == 1 and part[0] == pytest.approx(2 / (n + 1), abs=0.01)


def test_blocks_give_what_one_piece_gives(table, monkeypatch):
    rnd = np.random.default_rng(1)
    texts = pa.array([" ".join(np.array(WORDS)[rnd.choice(5, size, p=p)]) for size, p in ((400, [0.5, 0.3, 0.2, 0, 0]), (300, [0.1, 0.2, 0.3, 0.4, 0]), (90, [0, 0, 0, 0, 1]))])
    want = language.infer(texts, table)
    monkeypatch.setattr(language, "BLOCK", 37)
    got = language.infer(texts, table)
    assert got[0].tolist() == want[0].tolist() and np.allclose(got[1], want[1], atol=1e-4)
