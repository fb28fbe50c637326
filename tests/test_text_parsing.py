"""JSON in free text and numbers in answers, against results written out by hand."""

import pytest
from pyspark.sql import functions as F

from heatline.functions import calc, jsontext, text
from heatline.operators import retrieval, scoring

FENCE = "```json\n{}\n```"


@pytest.mark.parametrize(
    "answer, want",
    [
        (None, (None, "empty")), ("  ", (None, "empty")), ('{"b": 1, "a": 2}', ('{"a":2,"b":1}', "direct")), ("[1]", (None, "invalid")), ("3", (None, "invalid")), ("null", (None, "invalid")),
        (FENCE.replace("{}", "not json") + ' then {"a":1}', ('{"a":1}', "embedded")),
        (FENCE.replace("{}", '{"a":1}') + "\n```\nplain\n```", ('{"a":1}', "fenced")),
        (FENCE.replace("{}", '{"a":1}') + FENCE.replace("{}", "{broken}"), ('{"a":1}', "fenced")),
        (FENCE.replace("{}", '{"a":1}') + FENCE.replace("{}", '{"b":1}'), (None, "ambiguous")),
        (FENCE.replace("{}", '{"a":1}') + ' and {"c":2}', ('{"a":1}', "fenced")), ("```JSON{\"a\":{\"b\":1}}```", ('{"a":{"b":1}}', "fenced")),
        ('so {"a": {"b": 1}} it is', ('{"a":{"b":1}}', "embedded")), ('{"a":1} or {"a":2}', (None, "ambiguous")), ("none {", (None, "invalid")), ("{" * 3000, (None, "invalid")),
        ('{x {"a":1}', ('{"a":1}', "embedded")), ("[" * 100_000, (None, "invalid")),
    ],
)
def test_the_single_object_of_a_text(answer, want):
    assert jsontext.single_object(answer) == want


@pytest.mark.parametrize(
    "answer, want",
    [
        (None, []), ("no number", []), ("K = 12.50×10^3", [12500.0, 12.5, 10.0, 3.0]), ("5.0%", [0.05, 5.0]), ("3/4", [0.75, 3.0, 4.0]), ("1,234.5 kg", [1234.5]), ("-.5e-3", [-0.0005]),
        ("2 x 10⁻²", [0.02, 2.0, 10.0, 2.0]), (r"1.5 \times 10^{-4}", [0.00015, 1.5, 10.0, -4.0]), ("CO2 and x1", []), ("7/0", [7.0, 0.0]), ("3×10**2", [300.0, 3.0, 10.0, 2.0]),
        ("3.2\u00a0×\u300010^5", [320000.0, 3.2, 10.0, 5.0]), (r"2 \Times 10^{3}", [2000.0, 2.0, 10.0, 3.0]), ("2\\TIMES\u202f10 ^ { 3 }", [2000.0, 2.0, 10.0, 3.0]), ("12\u00a0%", [0.12, 12.0]), ("５％", [0.05, 5.0]),
        ("4 X 10 3", [4000.0, 4.0, 10.0, 3.0]), ("1\t/\u30004", [0.25, 1.0, 4.0]), ("1/2/3", [0.5, 1.0, 2.0, 3.0]), ("5-3/4", [0.75, 5.0, 3.0, 4.0]), ("3/45.6", [3.0, 45.6]), ("1.5/2", [1.5, 2.0]),
        ("2×10^3×10^4", [2000.0, 2.0, 10.0, 3.0, 10.0, 4.0]), ("a×10^3×10^4", [30000.0, 10.0, 3.0, 10.0, 4.0]), ("3,4 and 1,234,567.8", [3.0, 4.0, 1234567.8]), ("1.5.3", [1.5]), ("3--4", [3.0, -4.0]),
        ("3,.5", [3.0, 0.5]), ("max10", []), ("约5个，6。", [5.0, 6.0]), ("1e5 2E-3", [100000.0, 0.002]), ("x10", []), ("%", []), ("-7%", [-0.07, -7.0]), ("6×10⁻² m", [0.06, 6.0, 10.0, 2.0]),
    ],
)
def test_the_numbers_of_an_answer(spark, answer, want):
    df = spark.createDataFrame([(answer,)], "t string")
    got = df.select(scoring.answer_numbers(F.col("t")).alias("n")).collect()[0]["n"]
    assert sorted(round(x, 9) for x in got) == sorted(want)


@pytest.mark.parametrize("gap", ["\t", "\u3000", "\u00a0", "\u0085", "\u001c", " \u2003 "])
def test_white_space_of_any_kind(spark, gap):
    row = spark.createDataFrame([(f"{gap}NASA{gap}多项式{gap}", f"b{gap}|{gap}|a c", gap)], "q string, parts string, empty string")
    got = row.select(retrieval.normalised_query(F.col("q")), calc.pipe_set(F.col("parts")), text.blank(F.col("empty")), text.blank(F.col("q"))).collect()[0]
    assert tuple(got) == ("nasa 多项式", ["a c", "b"], True, False)


@pytest.mark.parametrize("given", ["STRASSE", "straße", "ΟΔΟΣ οδος", "Ünï ﬁ ǅ", "ſ K"])
def test_letter_case_as_the_standard_folds_it(spark, given):
    assert spark.createDataFrame([(given,)], "t string").select(text.folded(F.col("t"))).collect()[0][0] == given.casefold()
