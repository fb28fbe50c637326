"""Contrasts against numpy, ranks and signed ranks against all sign patterns, reconciliation and chains against plain versions."""

import hashlib
import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heatline.operators import chains, inference

TERMS = ("a", "b", "c")
BETA = np.array([0.4, -1.2, 0.9])
SIGMA = np.array([[0.20, 0.03, -0.02], [0.03, 0.10, 0.01], [-0.02, 0.01, 0.30]])


def model(spark):
    beta = spark.createDataFrame([("m", t, float(b)) for t, b in zip(TERMS, BETA)], "model string, term string, value double")
    sigma = spark.createDataFrame([("m", r, c, float(SIGMA[i, j])) for i, r in enumerate(TERMS) for j, c in enumerate(TERMS)], "model string, row_term string, column_term string, value double")
    return beta, sigma


def tails(z):
    up = 0.5 * math.erfc(z / math.sqrt(2))
    return {"two_sided": 2 * min(up, 1 - up), "greater": up, "less": 1 - up}


@pytest.mark.parametrize("alternative", inference.ALTERNATIVES)
def test_contrasts_equal_matrices(spark, alternative):
    w = np.array([1.0, -0.5, -0.5])
    weights = spark.createDataFrame([("x", t, float(v)) for t, v in zip(TERMS, w)] + [("lacking", "a", 1.0), ("lacking", "zz", -1.0)], "contrast string, term string, weight double")
    got = {r["contrast"]: r for r in inference.contrasts(*model(spark), weights, alternative).collect()}
    error = math.sqrt(w @ SIGMA @ w)
    assert (got["x"]["estimate"], got["x"]["std_error"], got["x"]["z"]) == pytest.approx((w @ BETA, error, w @ BETA / error))
    assert got["x"]["p_value"] == pytest.approx(tails(w @ BETA / error)[alternative])
    assert list(got["lacking"])[2:] == [None] * 4


def test_response_contrasts_equal_the_delta_method(spark):
    grid = np.array([[1, 0, 0], [1, 1, 0], [1, 0, 1], [1, 1, 2.5]])
    w = np.array([1.0, -1.0, -1.0, 1.0])
    rows = [(f"p{i}", t, float(grid[i, j])) for i in range(4) for j, t in enumerate(TERMS)]
    got = inference.response_contrasts(*model(spark), spark.createDataFrame(rows, "point string, term string, value double"), spark.createDataFrame([("did", f"p{i}", float(v)) for i, v in enumerate(w)], "contrast string, point string, weight double"), "greater").collect()[0]
    p = 1 / (1 + np.exp(-grid @ BETA))
    slope = (w * p * (1 - p)) @ grid
    error = math.sqrt(slope @ SIGMA @ slope)
    assert (got["estimate"], got["std_error"]) == pytest.approx((w @ p, error))
    assert got["p_value"] == pytest.approx(tails(w @ p / error)["greater"])


def test_support_by_family(spark):
    rows = [("f", "a", 1.0, 0.001), ("f", "b", 1.0, 0.02), ("g", "a", 1.0, 0.001), ("g", "b", 1.0, 0.5), ("h", "a", -1.0, 0.001), ("h", "b", 1.0, 0.001), ("i", "a", None, None)]
    got = inference.support(spark.createDataFrame(rows, "family string, contrast string, estimate double, p double"), ["family"], "contrast", "estimate", "p").collect()
    assert {(r["family"], r["support"]) for r in got} == {("f", "full_support"), ("g", "partial_support"), ("h", "not_supported"), ("i", "not_supported")}


def test_marginal_means(spark):
    grid = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "cell string, point int")
    assert sorted(map(tuple, inference.marginal_means(grid, ["cell"]).collect())) == [("x", 1, 0.5), ("x", 2, 0.5), ("y", 3, 1.0)]


def test_mid_ranks_over_many_ranges(spark):
    draw = random.Random(4)
    values = [draw.randrange(40) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v int").repartition(5)
    got = {r["value"]: r["rank"] for r in inference.mid_ranks(df, "v").collect()}
    assert got == {v: sum(x < v for x in values) + (values.count(v) + 1) / 2 for v in set(values)}
    assert inference.mid_ranks(df.filter("v < 0"), "v").collect() == []


def patterns(ranks, w):
    sums = [sum(r for r, s in zip(ranks, signs) if s) for signs in itertools.product((0, 1), repeat=len(ranks))]
    return sum(s >= w - 1e-9 for s in sums) / len(sums)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 9, 12, 15])
def test_signed_ranks_equal_all_sign_patterns(spark, n):
    draw = random.Random(n)
    d = [draw.choice((-3, -2, -1, 1, 2, 4)) / 2 for _ in range(n)]
    size = sorted(map(abs, d))
    rank = lambda x: (size.index(abs(x)) + 1 + size.index(abs(x)) + size.count(abs(x))) / 2
    w = sum(rank(x) for x in d if x > 0)
    got = inference.signed_rank_test(spark.createDataFrame([(x,) for x in d] + [(0.0,), (None,)], "d double"), "d").collect()[0]
    assert tuple(got) == pytest.approx((n, w, patterns([rank(x) for x in d], w) if n else 1.0))


def test_signed_ranks_of_many_pairs(spark):
    got = inference.signed_rank_test(spark.range(1, 201).select(F.when(F.col("id") % 3 == 0, -F.col("id")).otherwise(F.col("id")).cast("double").alias("d")), "d").collect()[0]
    w = sum(i for i in range(1, 201) if i % 3)
    z = (w - 200 * 201 / 4) / math.sqrt(200 * 201 * 401 / 24)
    assert tuple(got) == pytest.approx((200, w, 0.5 * math.erfc(z / math.sqrt(2))))


def test_reconcile(spark):
    recorded = [("a", 1, 1.0), ("b", 1, 2.0), ("b", 1, 2.0), ("c", 1, float("nan")), ("d", 1, None), ("e", 1, None), (None, 1, 5.0), ("x", 1, 0.0), ("g", 1, 1.05)]
    recomputed = [("a", 1, 1.05), ("b", 1, 2.5), ("c", 1, 1.0), ("d", 1, None), ("e", 1, 3.0), (None, 1, 5.0), ("y", 1, 0.0), ("g", 1, 1.2)]
    frame = lambda rows: spark.createDataFrame(rows, "k string, j int, v double")
    got = sorted(map(tuple, inference.reconcile(frame(recorded), frame(recomputed), ["k", "j"], {"v": 0.1}).collect()))
    assert got == [("b", 1, "recorded more than once"), ("b", 1, "v: differs"), ("c", 1, "v: not finite"), ("e", 1, "v: differs"), ("g", 1, "v: differs"), ("x", 1, "unexpected"), ("y", 1, "missing")]


def plain_chain(rows):
    before = {n: p for n, p in rows if n is not None}
    children = {}
    for n, p in before.items():
        children.setdefault(p, []).append(n)
    out = []
    for n in before:
        seen, at = [n], n
        while before[at] in before and before[at] not in seen:
            at = before[at]
            seen.append(at)
        endless = before[at] in before
        state = "ok"
        if before[at] is not None:
            state = "broken"
        if before[n] is not None and len(children[before[n]]) > 1:
            state = "fork"
        if endless:
            state = "cycle"
        out.append((n, None if endless else at, None if endless else len(seen) - 1, state))
    return sorted(out)


def test_chains_equal_following_them(spark):
    draw = random.Random(8)
    rows = [(i, i - 1 if i else None) for i in range(300)]
    rows += [(1000, 1001), (1001, 1002), (1002, 1000), (1003, 1002), (1004, 1004), (2000, 7777), (2001, 2000), (2002, 2001), (3000, 299), (3001, 299), (4000, None)]
    rows += [(5000 + i, draw.choice([None, 9999, *range(5000, 5000 + max(1, i))])) for i in range(60)]
    got = chains.chain_positions(spark.createDataFrame(rows, "id long, before long").repartition(4), "id", "before").collect()
    assert sorted(map(tuple, got)) == plain_chain(rows)


def test_chains_of_repeated_ids_and_none(spark):
    schema = "id long, before long"
    got = chains.chain_positions(spark.createDataFrame([(1, None), (2, 1), (2, 1), (None, 2)], schema), "id", "before").collect()
    assert sorted((r["node"], r["position"], r["state"]) for r in got) == [(1, 0, "ok"), (2, 1, "repeated")]
    assert chains.chain_positions(spark.createDataFrame([], schema), "id", "before").collect() == []


def test_record_ids_do_not_depend_on_order_or_blanks(spark):
    record = {"b": [1, {"d": None, "c": "é"}], "a": True}
    texts = [json.dumps(record), json.dumps(record, sort_keys=True, indent=2, ensure_ascii=False), "nope", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(chains.record_id(F.col("t"), "R-")).collect()]
    want = "R-" + hashlib.sha256(json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:20].upper()
    assert got == [want, want, None, None]
