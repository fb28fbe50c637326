"""Paired contrasts, hierarchical means, exact tests, agreement and cluster bootstrap.

Effects are small integers, so sums are taken in BIGINT and divided once: results
don't depend on the order of rows or on partitioning.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POOL_REPEATS = ("A", "B", "C", "D", "E")
#: The columns that mixed models take, in their order.
MODEL_COLUMNS = (
    "task_id", "selection_correct", "method", "minimal_pair_group", "target_tool_family", "pool_family_id", "pool_repeat", "model_run_repeat", "difficulty_score",
    "schema_token_count", "tool_pool_size", "near_neighbor_type", "near_neighbor_count",
)


def selection_correct(status: Column, execution: Column, selected: Column, acceptable: Column) -> Column:
    """Tri-state outcome: null where nothing could be observed, 0 for the model's own failures."""
    unseen = status.isin("not_accepted", "provider_failure", "timeout")
    failed = F.coalesce(execution.isin("model_failure", "invalid_response"), F.lit(False)) | status.isin("model_failure", "invalid_response")
    return F.when(unseen, F.lit(None).cast("int")).when(failed, 0).otherwise(F.coalesce(F.array_contains(acceptable, selected), F.lit(False)).cast("int"))


def cluster_id(group: Column, task: Column) -> Column:
    """The group, or the task where the group is null or empty."""
    return F.coalesce(F.nullif(group, F.lit("")), F.concat(F.lit("TASK::"), task))


def pair_conditions(df: DataFrame, key: list[str], condition: str, outcome: str, left: str, right: str, baseline: str | None = None) -> DataFrame:
    """One row per key with left, right (and baseline) outcomes, their difference and why a pair is missing.

    One grouped pass instead of self joins; duplicates of a cell count through ``cells``.
    """
    conditions = [left, right, *([baseline] if baseline else [])]
    at = lambda c, x: F.max(F.when(F.col(condition) == c, x))
    aggs = []
    for name, c in zip(("left", "right", "base"), conditions, strict=False):
        aggs += [at(c, F.col(outcome)).alias(f"{name}_value"), F.count_if(F.col(condition) == c).alias(f"{name}_cells")]
    rows = df.filter(F.col(condition).isin(*conditions)).groupBy(*key).agg(*aggs).filter("left_cells + right_cells > 0")
    missing = (
        F.when(F.col("left_cells") == 0, f"no {left}").when(F.col("right_cells") == 0, f"no {right}").when(F.col("left_value").isNull() | F.col("right_value").isNull(), "unobservable")
    )
    out = rows.withColumn("missing", missing).withColumn("difference", F.when(missing.isNull(), F.col("left_value") - F.col("right_value")))
    if baseline:
        out = out.withColumn("base_missing", F.when(missing.isNull() & F.col("base_value").isNull(), F.lit(True)).when(missing.isNull(), F.lit(False)))
    return out


def pool_means(rows: DataFrame, task: str, run: str, pool: str, effect: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Mean over pool repeats in each (task, run, extra), with whether the repeats are exactly A to E."""
    repeats = F.sort_array(F.collect_set(pool))
    return rows.groupBy(task, run, *extra).agg(
        (F.sum(F.col(effect).cast("bigint")) / F.count(effect)).alias("mean_effect"),
        F.size(repeats).alias("pool_repeat_count"),
        (repeats == F.array(*[F.lit(x) for x in POOL_REPEATS])).alias("complete"),
    )


def incomplete_repeats(rows: DataFrame, task: str, run: str, pool: str) -> DataFrame:
    """(task, run, missing, surplus): the gate before means are taken; no rows, no violations."""
    wanted = F.array(*[F.lit(x) for x in POOL_REPEATS])
    seen = rows.groupBy(task, run).agg(F.array_sort(F.collect_set(pool)).alias("_seen"))
    out = seen.select(task, run, F.array_except(wanted, "_seen").alias("missing"), F.array_except("_seen", wanted).alias("surplus"))
    return out.filter((F.size("missing") > 0) | (F.size("surplus") > 0))


def missingness_rows(records: DataFrame, pairs: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """(hypothesis, category, count, detail): how requests ended, and one row for every missing or repeated entry.

    ``records`` has request_status and execution_status; ``pairs`` names entries by (hypothesis,
    category).  The detail is JSON of all of an entry's columns, nulls among them.
    """
    keep = {"ignoreNullFields": "false"}
    ended = records.groupBy("request_status", "execution_status").agg(F.count(F.lit(1)).alias("count"))
    detail = F.to_json(F.struct("request_status", "execution_status"), keep)
    out = ended.select(F.lit("ALL").alias("hypothesis"), F.lit("execution_status").alias("category"), "count", detail.alias("detail"))
    for (hypothesis, category), entries in pairs.items():
        row = F.to_json(F.struct(*[F.col(c) for c in entries.columns]), keep)
        out = out.unionAll(entries.select(F.lit(hypothesis), F.lit(category), F.lit(1).cast("long"), row))
    return out


def model_rows(records: DataFrame, outcome: str = "selection_correct") -> DataFrame:
    """The columns that a mixed model takes, of records whose outcome was observed; those without a group are their own."""
    group = cluster_id(F.col("minimal_pair_group"), F.col("task_id")).alias("minimal_pair_group")
    return records.filter(F.col(outcome).isNotNull()).select(*[group if c == "minimal_pair_group" else F.col(c) for c in MODEL_COLUMNS])


def run_means(means: DataFrame, run: str) -> DataFrame:
    return means.groupBy(run).agg(F.count(F.lit(1)).alias("task_count"), F.avg("mean_effect").alias("run_effect"))


def overall_effect(means: DataFrame, run: str) -> DataFrame:
    """The unweighted mean of run means."""
    return run_means(means, run).agg(F.avg("run_effect").alias("overall_effect"))


def sign_test_p(positives: Column, n: Column, alternative: str = "greater") -> Column:
    """Exact binomial tail at one half by log factorials; 1 for no non-zero effects."""
    if alternative not in ("greater", "less"):
        raise ValueError("alternative must be 'greater' or 'less'")
    low, high = (positives, n) if alternative == "greater" else (F.lit(0).cast("bigint"), positives)
    logs = lambda m: F.aggregate(F.sequence(F.lit(0).cast("bigint"), m), F.lit(0.0), lambda acc, x: acc + F.log(F.greatest(x, F.lit(1)).cast("double")))
    term = lambda k: F.exp(logs(n) - logs(k) - logs(n - k) - n * math.log(2.0))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), F.aggregate(F.sequence(low, high), F.lit(0.0), lambda acc, k: acc + term(k))))


def holm(df: DataFrame, family: list[str], name: str, p: str) -> DataFrame:
    """Holm-adjusted p values within each family."""
    order = Window.partitionBy(*family).orderBy(p, name)
    size = F.count(F.lit(1)).over(Window.partitionBy(*family))
    raw = F.least(F.lit(1.0), (size - F.row_number().over(order) + 1) * F.col(p))
    return df.withColumn("_raw", raw).withColumn("p_holm", F.max("_raw").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_raw")


def comparison_report(contrasts: DataFrame, comparison: str, task: str, run: str, effect: str, level: float = 0.05) -> DataFrame:
    """One row per planned comparison: estimate, one-sided sign test over tasks, Holm p, and whether all comparisons support the hypothesis.

    ``contrasts`` has a mean effect for each (comparison, task, run).  The estimate is the mean
    of run means, a task's effect the mean over its runs.  Support asks that every estimate be
    positive and every adjusted p below ``level``; without comparisons there are no rows.
    """
    estimates = contrasts.groupBy(comparison, run).agg(F.avg(effect).alias("_e")).groupBy(comparison).agg(F.avg("_e").alias("estimate"))
    tasks = contrasts.groupBy(comparison, task).agg(F.avg(effect).alias("_e")).groupBy(comparison)
    signs = tasks.agg(F.count(F.lit(1)).alias("task_count"), F.count_if(F.col("_e") > 0).alias("_pos"), F.count_if(F.col("_e") != 0).alias("_n"))
    rows = estimates.join(signs, comparison).withColumn("p", sign_test_p(F.col("_pos"), F.col("_n"))).withColumn("_family", F.lit(1))
    holds = (F.col("estimate") > 0) & (F.col("p_holm") < level)
    out = holm(rows, ["_family"], comparison, "p").withColumn("support", F.min(holds).over(Window.partitionBy("_family")))
    return out.select(comparison, "estimate", "task_count", "p", "p_holm", "support")


def agreement(pairs: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """Raw agreement and Cohen's kappa of two label columns in each group; kappa is 1 where chance alone explains all."""
    cells = pairs.groupBy(*group, a, b).agg(F.count(F.lit(1)).alias("n"))
    margin = lambda c: cells.groupBy(*group, F.col(c).alias("_label")).agg(F.sum("n").alias(f"n_{c}"))
    expected = margin(a).join(margin(b), [*group, "_label"]).groupBy(*group).agg(F.sum(F.col(f"n_{a}") * F.col(f"n_{b}")).alias("_chance"))
    total = cells.groupBy(*group).agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("_same"))
    both = total.join(expected, group, "left") if group else total.join(expected)
    po, pe = F.col("_same") / F.col("n"), F.coalesce("_chance", F.lit(0)) / (F.col("n") * F.col("n"))
    return both.select(*group, "n", po.alias("raw_agreement"), F.when(F.abs(1 - pe) < 1e-12, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def cluster_sums(rows: DataFrame, cluster: str, run: str, effect: str) -> DataFrame:
    """Sufficient statistics of the bootstrap: sum and count of effects per cluster and run."""
    return rows.groupBy(cluster, run).agg(F.sum(effect).alias("s"), F.count(effect).alias("n"))


def bootstrap(sums: DataFrame, draws: DataFrame, cluster: str, run: str) -> DataFrame:
    """(b, effect): for each resample the unweighted mean of run means over drawn clusters.

    ``draws`` has b, a cluster and how often it was drawn (times).
    """
    runs = sums.join(draws, cluster).groupBy("b", run).agg((F.sum(F.col("s") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("m"))
    return runs.groupBy("b").agg(F.avg("m").alias("effect"))


def hashed_draws(clusters: DataFrame, cluster: str, resamples: int, seed: int) -> DataFrame:
    """Poisson-weighted draws by a hash of (seed, resample, cluster): no shared state, any number of clusters."""
    unit = F.pmod(F.xxhash64(F.lit(seed), F.col("b"), F.col(cluster)), F.lit(1_000_000)) / 1_000_000.0
    cuts, total, p = [], 0.0, math.exp(-1.0)
    for k in range(8):
        total += p
        cuts.append(total)
        p /= k + 1
    times = F.lit(0)
    for c in cuts:
        times = times + (unit >= c).cast("int")
    drawn = clusters.select(cluster, F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b"))
    return drawn.withColumn("times", times).filter("times > 0")


def seeded_draws(spark, cluster_ids: list[str], resamples: int, seed: int) -> DataFrame:
    """Draws of the standard seeded generator over sorted ids, for a bounded list of clusters (checked)."""
    if len(cluster_ids) * resamples > 20_000_000:
        raise ValueError("too many draws for one generator; use hashed_draws")
    rng, ids = random.Random(seed), sorted(cluster_ids)
    rows: list[tuple[int, str, int]] = []
    for b in range(resamples):
        times: dict[str, int] = {}
        for _ in ids:
            c = rng.choice(ids)
            times[c] = times.get(c, 0) + 1
        rows += [(b, c, n) for c, n in times.items()]
    return spark.createDataFrame(rows, "b int, cluster string, times int")


def interval(samples: DataFrame, value: str = "effect", level: float = 0.95) -> DataFrame:
    tail = (1 - level) / 2
    return samples.agg(F.percentile(value, tail).alias("lower"), F.percentile(value, 1 - tail).alias("upper"))


def support_class(directions: Column, significant: Column) -> Column:
    """full if every contrast has the right sign and is significant, partial if some is, else not supported."""
    both = directions & significant
    return F.when(F.bool_and(both), "full").when(F.count_if(both) > 0, "partial").otherwise("not_supported")
