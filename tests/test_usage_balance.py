"""Merged usage, balances of streams and rates of experiments against results written out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from heatline.operators import balance, contracts, documents, usage


def rounds(spark, rows):
    return spark.createDataFrame(rows, "run string, seq int, doc string").withColumn("doc", documents.document(F.col("doc")))


def merged(spark, rows):
    return {r["run"]: r["u"] and json.loads(r["u"]) for r in usage.merged(rounds(spark, rows), "run", ["seq"], "doc").select("run", F.to_json("usage").alias("u")).collect()}


def test_numbers_add_up_and_the_first_of_other_values_stays(spark):
    first = {"prompt": 10, "cost": 0.5, "details": {"cached": 3, "at": [1, 2]}, "tier": "standard", "flag": True}
    second = {"prompt": 5, "cost": 1, "details": {"cached": 9}, "tier": "other", "flag": True, "new": None}
    rows = [("a", 2, json.dumps(second)), ("a", 1, json.dumps(first)), ("a", 3, None)]
    assert merged(spark, rows) == {"a": {"prompt": 15, "cost": 1.5, "details": {"cached": 3, "at": [1, 2]}, "tier": "standard", "flag": 2, "new": None}}


def test_runs_without_usage_stay_with_null(spark):
    rows = [("none", 1, None), ("empty", 1, "{}"), ("list", 1, "[1]"), ("broken", 1, "{"), (None, 1, '{"x":1}'), (None, 2, '{"x":2}')]
    assert merged(spark, rows) == {"none": None, "empty": None, "list": None, "broken": None, None: {"x": 3}}
    assert merged(spark, []) == {}


def test_numbers_win_over_other_values_and_ties_go_to_the_least_text(spark):
    rows = [("a", 1, '{"x":"unknown","y":"b"}'), ("a", 2, '{"x":4}'), ("a", 1, '{"y":"a"}'), ("a", 3, '{"x":null}')]
    assert merged(spark, rows) == {"a": {"x": 4, "y": "a"}}


def test_large_whole_numbers_are_exact(spark):
    big = 2**53
    fields = usage.merged_fields(rounds(spark, [("a", i, json.dumps({"n": big + 1})) for i in range(3)]), "run", ["seq"], "doc")
    assert [r["total"] for r in fields.collect()] == [str(3 * (big + 1))]


def test_the_order_of_rows_and_extra_columns_do_not_matter(spark):
    rows = [("a", i, json.dumps({"n": i, "t": f"t{i}"})) for i in range(50)]
    df = rounds(spark, rows).withColumn("name", F.lit("clash")).withColumn("value", F.lit("clash")).repartition(7)
    out = {r["name"]: (r["total"], r["first"]) for r in usage.merged_fields(df, "run", ["seq"], "doc").select("name", "total", F.to_json("first").alias("first")).collect()}
    assert out == {"n": ("1225", None), "t": (None, '"t0"')}


STREAMS = "k string, side string, mass double, elements map<string,double>"


def test_balances_of_streams(spark):
    rows = [
        ("closed", "input", 100.0, {"Fe": 0.6, "O": 0.4}), ("closed", "output", 60.0, {"Fe": 1.0}), ("closed", "output", 40.0, {"O": 1.0}),
        ("open", "input", 100.0, {"Fe": 0.5}), ("open", "input", 10.0, {}), ("open", "output", 100.0, {"Fe": 0.48, "C": 0.001}),
        ("one side", "input", 5.0, {"Fe": 1.0}), ("nothing in", "input", None, None), ("nothing in", "output", 0.25, {"C": 1.0}),
    ]
    df = spark.createDataFrame(rows, STREAMS)
    got = {r[0]: tuple(r)[1:] for r in balance.balance_checks(df, "k").collect()}
    assert got == {
        "closed": (100.0, 100.0, 1.0, 0.0, True, None), "open": (110.0, 100.0, round(1 - 10 / 110, 6), 2.0, False, None),
        "one side": (None, None, None, None, None, "INVALID_INPUT"), "nothing in": (0.0, 0.25, 0.75, 0.25, False, None),
    }
    elements = {(r["k"], r["element"]): (r["input"], r["output"]) for r in balance.element_balances(df, "k").collect()}
    assert elements[("open", "C")] == (0.0, 0.1) and elements[("nothing in", "C")] == (0.0, 0.25) and len(elements) == 6
    assert balance.balance_checks(spark.createDataFrame([], STREAMS), "k").count() == 0


def test_a_residual_at_the_tolerance_passes(spark):
    df = spark.createDataFrame([("a", "input", 1.0, {"C": 0.5}), ("a", "output", 1.0, {"C": 0.25})], STREAMS)
    assert [balance.balance_checks(df, "k", t).first()["passed"] for t in (0.25, 0.2499)] == [True, False]


RUN = "completed boolean, sequence_recall double, calls int, ineffective int, unsuccessful int, unnecessary int, duplicate int, candidates int, fallback boolean, tokens long, latency double, " + ", ".join(f"{m} boolean" for m in contracts.METRICS)


def test_rates_of_experiments(spark):
    metrics = lambda **told: tuple(told.get(m) for m in contracts.METRICS)
    rows = [
        (True, 1.0, 2, 1, 0, 1, 0, 5, True, 100, 10.0, *metrics(semantic_case_passed=True, case_passed=True)),
        (False, 0.5, 1, 0, 1, 0, 0, 0, False, None, 20.0, *metrics(semantic_case_passed=False, case_passed=True)),
        (None, 0.0, 0, 0, 0, 0, 0, None, None, 50, 30.5, *metrics(case_passed=False)),
    ]
    got = spark.createDataFrame(rows, RUN).agg(*contracts.run_aggregate()).first().asDict()
    assert len([k for k in got if k.removesuffix("_rate") in contracts.METRICS]) == 13
    told = {"experiment_count": 3, "completed_count": 1, "failed_count": 2, "completion_rate": 0.3333, "scored_count": 2, "manual_count": 1, "semantic_case_passed_rate": 0.5, "case_passed_rate": 0.6667, "outcome_correct_rate": None}
    told |= {"average_sequence_recall": 0.5, "average_calls": 1.0, "ineffective_rate": 0.3333, "unsuccessful_rate": 0.3333, "duplicate_rate": 0.0, "average_candidates": 1.6667, "fallback_rate": 0.3333, "empty_rate": 0.6667}
    told |= {"total_tokens": 150, "average_latency": 20.167}
    assert {k: got[k] for k in told} == told


@pytest.mark.parametrize("calls, expected", [(None, None), (0, 0.0)])
def test_rates_without_experiments_or_calls(spark, calls, expected):
    row = (True, 1.0, calls, 0, 0, 0, 0, 0, False, 0, 1.0, *[None] * 13)
    got = spark.createDataFrame([] if calls is None else [row], RUN).agg(*contracts.run_aggregate()).first()
    assert got["ineffective_rate"] == expected and got["total_tokens"] == 0 and got["experiment_count"] == (calls is not None)
