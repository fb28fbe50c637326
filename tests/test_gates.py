"""Policies, gates, audits and forms against results written out by hand."""

import json

from pyspark.sql import functions as F

from heatline.operators import relational, stats, validation

LABEL = "task string, risk_status string, answerability string, evidence_requirement string, capability_status string, information_status string, allowed_actions array<string>"
EXCEPTION = "task string, default_actions array<string>, accepted_actions array<string>"


def test_actions_against_the_policy_and_its_exceptions(spark):
    plain = lambda task, actions, need="required", info="sufficient": (task, "normal", "answerable", need, "available", info, actions)
    rows = [
        plain("right", ["call"]), plain("any order", ["call", "answer", "call"], "optional"), plain("differs", ["answer"]), plain("listed", ["refuse", "answer"]), plain("lapsed", ["answer"], info="missing"),
        plain("other set", ["clarify"]), plain("none", []), plain("null", None), plain("odd", ["guess", "call"]), plain("no rule", ["call"], None), plain(None, ["answer"]),
    ]
    listed = [("listed", ["call"], ["answer", "refuse"]), ("listed", ["call"], ["refuse", "answer", "answer"]), ("listed", ["call"], ["clarify"]), ("lapsed", ["call"], ["answer"]), ("other set", ["call"], ["answer"]), ("unused", ["call"], ["call"])]
    got = validation.action_policy(spark.createDataFrame(rows, LABEL), spark.createDataFrame(listed, EXCEPTION), "task").collect()
    assert len(got) == len(rows)
    assert {r["task"]: r["outcome"] for r in got} == {
        "right": "default", "any order": "default", "differs": "differs", "listed": "override", "lapsed": "differs", "other set": "differs", "none": "no actions", "null": "no actions",
        "odd": "unknown action", "no rule": "no default", None: "differs",
    }
    assert validation.action_policy(spark.createDataFrame([], LABEL), spark.createDataFrame([], EXCEPTION), "task").count() == 0


def test_only_incomplete_repeats_are_named(spark):
    rows = [("whole", 1, p) for p in "ABCDE" * 2] + [("part", 1, p) for p in "EA"] + [("more", 2, p) for p in "ABCDEF"] + [("part", None, None)]
    got = stats.incomplete_repeats(spark.createDataFrame(rows, "task string, run int, pool string"), "task", "run", "pool")
    assert sorted((r["task"], r["run"] or 0, "".join(r["missing"]), "".join(r["surplus"])) for r in got.collect()) == [("more", 2, "", "F"), ("part", 0, "ABCDE", ""), ("part", 1, "BCD", "")]


def test_audit_has_counts_and_one_row_for_each_entry(spark):
    records = spark.createDataFrame([("ok", "success"), ("ok", "success"), ("failed", None)], "request_status string, execution_status string")
    entries = spark.createDataFrame([("t", None), ("t", None)], "task string, run int")
    got = stats.missingness_rows(records, {("H4", "missing_pair"): entries, ("H4", "duplicate_cell"): entries.limit(0)}).collect()
    assert sorted((r["hypothesis"], r["category"], r["count"], r["detail"]) for r in got) == [
        ("ALL", "execution_status", 1, '{"request_status":"failed","execution_status":null}'), ("ALL", "execution_status", 2, '{"request_status":"ok","execution_status":"success"}'),
        ("H4", "missing_pair", 1, '{"task":"t","run":null}'), ("H4", "missing_pair", 1, '{"task":"t","run":null}'),
    ]


def test_rows_of_models_have_observed_outcomes_and_a_group(spark):
    types = ", ".join(f"{c} string" for c in stats.MODEL_COLUMNS)
    row = lambda task, outcome, group: tuple({"task_id": task, "selection_correct": outcome, "minimal_pair_group": group}.get(c, c) for c in stats.MODEL_COLUMNS)
    df = spark.createDataFrame([row("a", "1", "g"), row("b", "0", ""), row("c", "0", None), row("d", None, "g")], types).withColumn("extra", F.lit(1))
    got = stats.model_rows(df)
    assert tuple(got.columns) == stats.MODEL_COLUMNS
    assert sorted((r["task_id"], r["minimal_pair_group"]) for r in got.collect()) == [("a", "g"), ("b", "TASK::b"), ("c", "TASK::c")]


def test_forms_drop_what_is_not_filled_and_read_numbers(spark):
    form = {"a": "12 mm", "b": "", "c": None, "d": "-.5e1x", "e": "text", "f": "none", "g": "0"}
    df = spark.createDataFrame([(form,), ({},), (None,)], "form map<string,string>")
    got = df.select(F.to_json(F.to_variant_object(relational.form_parameters(F.col("form"), F.array(*map(F.lit, "abcdfg"))))).alias("p")).collect()
    assert [r["p"] and json.loads(r["p"]) for r in got] == [{"a": 12.0, "d": -5.0, "e": "text", "f": None, "g": 0.0}, {}, None]


def test_eligible_cases_stand_in_every_table_once(spark):
    cases = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (4, None)], "id int, tool string")
    table = lambda *tools: spark.createDataFrame([(t,) for t in tools], "tool string")
    got = relational.eligible(cases, "tool", table("A", "A", "B", None), table("A", None))
    assert sorted(r["id"] for r in got.collect()) == [1, 2]
