"""Planned contrasts on long tables, ranks and signed-rank tests, and the comparison of recorded with recomputed results.

Matrices are long tables (row, column, value), so products are joins and grouped sums and
nothing depends on how many models, terms or contrasts there are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import stats
from .documents import _checkpointed

ALTERNATIVES = ("two_sided", "greater", "less")
#: Non-zero differences up to which the signed-rank distribution is computed exactly.
EXACT_PAIRS = 60


@F.arrow_udf(T.DoubleType())
def upper_tail(z: pa.Array) -> pa.Array:
    """The standard normal probability above z."""
    return pa.array([None if x is None else 0.5 * math.erfc(x / math.sqrt(2)) for x in z.to_pylist()], pa.float64())


def z_test(estimate: Column, variance: Column, alternative: Column | str = "two_sided") -> dict[str, Column]:
    """Standard error, z and p of estimates; z and p are null without a positive variance."""
    kind = alternative if isinstance(alternative, Column) else F.lit(alternative)
    error = F.when(variance >= 0, F.sqrt(variance))
    z = F.when(error > 0, estimate / error)
    p = F.when(kind == "two_sided", 2 * upper_tail(F.abs(z))).when(kind == "greater", upper_tail(z)).when(kind == "less", upper_tail(-z))
    return {"std_error": error, "z": z, "p_value": p}


def marginal_means(grid: DataFrame, keep: list[str]) -> DataFrame:
    """Weights of the mean over a grid's other columns: (*keep, point, weight) with equal weight for each point of a cell."""
    return grid.withColumn("weight", 1 / F.count(F.lit(1)).over(Window.partitionBy(*keep))).select(*keep, "point", "weight")


def _quadratic(slopes: DataFrame, covariance: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, variance): w' S w of every contrast."""
    left = slopes.select(*keys, F.col("term").alias("row_term"), F.col("weight").alias("_a"))
    right = slopes.select(*keys, F.col("term").alias("column_term"), F.col("weight").alias("_b"))
    model = [k for k in keys if k in covariance.columns]
    half = left.join(covariance, [*model, "row_term"]).groupBy(*keys, "column_term").agg(F.sum(F.col("_a") * F.col("value")).alias("_h"))
    return half.join(right, [*keys, "column_term"]).groupBy(*keys).agg(F.sum(F.col("_h") * F.col("_b")).alias("variance"))


def contrasts(beta: DataFrame, covariance: DataFrame, weights: DataFrame, alternative: Column | str = "two_sided") -> DataFrame:
    """(model, contrast, estimate, std_error, z, p_value) of weighted sums of estimates.

    ``beta`` has model, term and value, ``covariance`` model, row_term, column_term and value,
    ``weights`` contrast, term and weight.  A contrast that uses a term which a model lacks
    has null figures there.
    """
    # Each model has a figure for each contrast, so their product is the result itself.
    used = beta.select("model").distinct().crossJoin(weights).join(beta, ["model", "term"], "left")
    sums = used.groupBy("model", "contrast").agg(F.when(F.count("value") == F.count(F.lit(1)), F.sum(F.col("weight") * F.col("value"))).alias("estimate"))
    spread = _quadratic(used.select("model", "contrast", "term", "weight"), covariance, ["model", "contrast"])
    out = sums.join(spread, ["model", "contrast"], "left").withColumn("variance", F.when(F.col("estimate").isNotNull(), F.col("variance")))
    return out.select("model", "contrast", "estimate", *[c.alias(n) for n, c in z_test(F.col("estimate"), F.col("variance"), alternative).items()])


def response_contrasts(beta: DataFrame, covariance: DataFrame, grid: DataFrame, weights: DataFrame, alternative: Column | str = "two_sided") -> DataFrame:
    """As ``contrasts``, on the scale of probabilities of a logistic model, with delta-method errors.

    ``grid`` has point, term and value (the design rows), ``weights`` contrast, point and weight.
    """
    lines = beta.withColumnRenamed("value", "_b").join(grid.withColumnRenamed("value", "_x"), "term")
    points = lines.groupBy("model", "point").agg(F.sum(F.col("_x") * F.col("_b")).alias("_eta")).withColumn("_p", 1 / (1 + F.exp(-F.col("_eta"))))
    chosen = points.join(weights, "point")
    sums = chosen.groupBy("model", "contrast").agg(F.sum(F.col("weight") * F.col("_p")).alias("estimate"))
    slopes = chosen.withColumn("_w", F.col("weight") * F.col("_p") * (1 - F.col("_p"))).join(grid, "point").groupBy("model", "contrast", "term").agg(F.sum(F.col("_w") * F.col("value")).alias("weight"))
    out = sums.join(_quadratic(slopes, covariance, ["model", "contrast"]), ["model", "contrast"], "left")
    return out.select("model", "contrast", "estimate", *[c.alias(n) for n, c in z_test(F.col("estimate"), F.col("variance"), alternative).items()])


def support(rows: DataFrame, family: list[str], contrast: str, estimate: str, p: str, level: float = 0.05) -> DataFrame:
    """Holm's p, which contrasts pass (positive and below ``level``), and the family's support: full, partial or none."""
    out = stats.holm(rows, family, contrast, p).withColumn("passed", F.coalesce((F.col(estimate) > 0) & (F.col("p_holm") < level), F.lit(False)))
    own = Window.partitionBy(*family)
    every, some, positive = F.min("passed").over(own), F.max("passed").over(own), F.min(F.coalesce(F.col(estimate) > 0, F.lit(False))).over(own)
    return out.withColumn("support", F.when(every, "full_support").when(positive & some, "partial_support").otherwise("not_supported"))


# ---- ranks ----


def mid_ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, n, rank): how often each value of a column stands there, and the mid-rank of its rows; nulls have none.

    Values are counted, dealt to ranges and written; the rows of the ranges before, one
    number for each, then give every rank: no task holds more than a range of values.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ranged = _checkpointed(counts.repartitionByRange("value").sortWithinPartitions("value").withColumn("_part", F.spark_partition_id()))
    ahead, before = [], 0
    for part, n in sorted(map(tuple, ranged.groupBy("_part").agg(F.sum("n")).collect())):  # one row for each range
        ahead.append((part, before))
        before += n
    ranges = df.sparkSession.createDataFrame(ahead, "_part int, _ahead long")
    upto = F.sum("n").over(Window.partitionBy("_part").orderBy("value"))
    placed = ranged.withColumn("_upto", upto).join(F.broadcast(ranges), "_part")
    return placed.select("value", "n", (F.col("_ahead") + F.col("_upto") - (F.col("n") - 1) / 2).alias("rank"))


def exact_signed_rank(doubled: list[int], statistic: float) -> float:
    """P(sum of the ranks of positive signs >= statistic) over all sign patterns; ranks are given doubled."""
    ways = np.zeros(sum(doubled) + 1)
    ways[0] = 1.0
    for r in doubled:
        ways[r:] = (ways[r:] + ways[: len(ways) - r].copy()) / 2 if r else ways
        ways[:r] /= 2
    return float(ways[max(0, math.ceil(2 * statistic - 1e-9)) :].sum())


def signed_rank_test(df: DataFrame, difference: str) -> DataFrame:
    """One row: pairs with a difference, W+ and the one-sided p of Wilcoxon's test (greater), by mid-ranks of absolute differences.

    Exact up to ``EXACT_PAIRS`` pairs; beyond that by the normal approximation with the
    correction for ties.  Zero and null differences are left out; without any p is 1.
    """
    d = df.filter(F.col(difference) != 0).select(F.abs(difference).alias("_size"), (F.col(difference) > 0).alias("_positive"))
    ranks = _checkpointed(mid_ranks(d, "_size"))
    positive = d.filter("_positive").groupBy("_size").agg(F.count(F.lit(1)).alias("_pos"))
    both = ranks.join(positive, ranks["value"] == positive["_size"], "left")
    n, w, ties = both.agg(F.sum("n"), F.sum(F.col("rank") * F.coalesce("_pos", F.lit(0))), F.sum(F.col("n").cast("double") ** 3 - F.col("n"))).collect()[0]
    n, w = n or 0, float(w or 0.0)
    if n == 0:
        p = 1.0
    elif n <= EXACT_PAIRS:
        held = ranks.select("n", "rank").collect()  # EXACT_PAIRS rows at most
        p = exact_signed_rank([round(2 * r["rank"]) for r in held for _ in range(r["n"])], w)
    else:
        variance = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
        p = 0.5 * math.erfc((w - n * (n + 1) / 4) / math.sqrt(2 * variance)) if variance > 0 else 1.0
    return df.sparkSession.createDataFrame([(n, w, p)], "n long, w_plus double, p_value double")


# ---- recorded against recomputed ----


def reconcile(recorded: DataFrame, recomputed: DataFrame, keys: list[str], tolerances: dict[str, float]) -> DataFrame:
    """(keys, rule): rows of one side only, repeated rows, and columns that aren't finite or differ by more than their tolerance.

    Keys may be null.  Both sides may miss a value; a value against none differs.
    """
    side = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"_{name}"), *[F.first(F.col(c).cast("double")).alias(f"_{name}_{c}") for c in tolerances])
    left, right = side(recorded, "a"), side(recomputed, "b").withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = [left[k].eqNullSafe(right[f"_k_{k}"]) for k in keys]
    rows = left.join(right, same, "full")
    there = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    broken = {"missing": F.col("_a").isNull(), "unexpected": F.col("_b").isNull(), "recorded more than once": F.col("_a") > 1, "recomputed more than once": F.col("_b") > 1}
    for c, tolerance in tolerances.items():
        a, b = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        finite = ~F.isnan(a) & (F.abs(a) < F.lit(float("inf")))
        broken[f"{c}: not finite"] = there & ~F.coalesce(finite, F.lit(True))
        broken[f"{c}: differs"] = there & F.coalesce(finite, F.lit(True)) & ~F.coalesce(F.abs(a - b) <= tolerance, a.isNull() & b.isNull())
    rules = F.array_compact(F.array(*[F.when(F.coalesce(x, F.lit(False)), name) for name, x in broken.items()]))
    names = [F.when(F.col("_b").isNotNull(), F.col(f"_k_{k}")).otherwise(F.col(k)).alias(k) for k in keys]
    return rows.select(*names, F.explode(rules).alias("rule"))


def quantiles(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """(p, v): exact quantiles with linear interpolation, by order statistics out of ``mid_ranks``; null without values."""
    ranked = _checkpointed(mid_ranks(df, value).select("value", F.col("n"), (F.col("rank") + (F.col("n") - 1) / 2).cast("long").alias("upto")))
    total = ranked.agg(F.sum("n")).collect()[0][0] or 0
    places = {p: p * (total - 1) for p in shares}
    wanted = sorted({k for x in places.values() for k in (math.floor(x), math.ceil(x))})
    holds = F.exists(F.array(*map(F.lit, wanted)), lambda k: (k >= F.col("upto") - F.col("n")) & (k < F.col("upto")))
    found = [(r["upto"] - r["n"], r["upto"], float(r["value"])) for r in ranked.filter(holds).collect()] if total else []  # two rows for each share at most
    at = {k: next((v for low, high, v in found if low <= k < high), None) for k in wanted}
    rows = [(p, at[math.floor(x)] + (at[math.ceil(x)] - at[math.floor(x)]) * (x - math.floor(x)) if total else None) for p, x in places.items()]
    return df.sparkSession.createDataFrame(rows, "p double, v double")
