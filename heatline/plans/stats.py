"""Queries of paired contrasts, hierarchical means, tests, agreement and resampling, over orders.

Condition is the order's status (three levels), pool repeat its priority (five), task a
hash of its key, run a residue of the customer, and the outcome a price threshold.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import refdata
from ..operators import inference, stats
from ..sources.tables import read
from .base import query

_ROWS = """(SELECT 'T' || (o_orderkey % 37) AS task, o_custkey % 3 AS run, substr('ABCDE', substr(o_orderpriority, 1, 1)::INT, 1) AS pool, o_orderstatus AS cond,
    CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE (o_totalprice > 150000)::INT END AS y, 'C' || (o_custkey % 23) AS cluster FROM orders)"""
_CELLS = f"""(SELECT task, run, pool, cluster, max(y) FILTER (cond = 'F') AS l, max(y) FILTER (cond = 'O') AS r, max(y) FILTER (cond = 'P') AS b, count(*) FILTER (cond = 'F') AS ln, count(*) FILTER (cond = 'O') AS rn
    FROM {_ROWS} GROUP BY 1, 2, 3, 4 HAVING count(*) FILTER (cond IN ('F', 'O')) > 0)"""
_DIFFS = f"(SELECT *, l - r AS d FROM {_CELLS} WHERE l IS NOT NULL AND r IS NOT NULL)"
_MEANS = f"(SELECT task, run, sum(d) / count(d) AS m, count(DISTINCT pool) AS pools FROM {_DIFFS} GROUP BY 1, 2)"


def _rows(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("T"), (F.col("o_orderkey") % 37).cast("string")).alias("task"), (F.col("o_custkey") % 3).alias("run"),
        F.substring(F.lit("ABCDE"), F.substring("o_orderpriority", 1, 1).cast("int"), F.lit(1)).alias("pool"), F.col("o_orderstatus").alias("cond"),
        F.when(F.col("o_orderkey") % 19 != 0, (F.col("o_totalprice") > 150000).cast("int")).alias("y"), F.concat(F.lit("C"), (F.col("o_custkey") % 23).cast("string")).alias("cluster"),
    )


def _pairs(spark, sf_dir):
    return stats.pair_conditions(_rows(spark, sf_dir), ["task", "run", "pool", "cluster"], "cond", "y", "F", "O", "P")


def _means(spark, sf_dir):
    return stats.pool_means(_pairs(spark, sf_dir).filter("difference IS NOT NULL"), "task", "run", "pool", "difference")


@query(f"""SELECT task, run, pool, cluster, l - r AS difference, CASE WHEN ln = 0 THEN 'no F' WHEN rn = 0 THEN 'no O' WHEN l IS NULL OR r IS NULL THEN 'unobservable' END AS missing,
    CASE WHEN ln > 0 AND rn > 0 AND l IS NOT NULL AND r IS NOT NULL THEN b IS NULL END AS base_missing FROM {_CELLS}""")
def paired_contrasts(spark, sf_dir):
    return _pairs(spark, sf_dir).select("task", "run", "pool", "cluster", "difference", "missing", "base_missing")


@query(f"SELECT coalesce(CASE WHEN ln = 0 THEN 'no F' WHEN rn = 0 THEN 'no O' WHEN l IS NULL OR r IS NULL THEN 'unobservable' END, 'paired') AS state, count(*) AS n FROM {_CELLS} GROUP BY 1")
def missingness_audit(spark, sf_dir):
    return _pairs(spark, sf_dir).groupBy(F.coalesce("missing", F.lit("paired")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT task, run, round(m, 9) AS mean_effect, pools::INT AS pool_repeat_count, pools = 5 AS complete FROM {_MEANS}")
def pool_repeat_means(spark, sf_dir):
    return _means(spark, sf_dir).select("task", "run", F.round("mean_effect", 9).alias("mean_effect"), "pool_repeat_count", "complete")


@query(f"SELECT run, count(*) AS task_count, round(avg(m), 9) AS run_effect FROM {_MEANS} GROUP BY run")
def run_repeat_means(spark, sf_dir):
    return stats.run_means(_means(spark, sf_dir), "run").select("run", "task_count", F.round("run_effect", 9).alias("run_effect"))


@query(f"SELECT round(avg(e), 9) AS overall_effect FROM (SELECT run, avg(m) AS e FROM {_MEANS} GROUP BY run)")
def overall_effect(spark, sf_dir):
    return stats.overall_effect(_means(spark, sf_dir), "run").select(F.round("overall_effect", 9).alias("overall_effect"))


@query(f"""WITH t AS (SELECT task, avg(m) AS e FROM {_MEANS} GROUP BY 1), s AS (SELECT count(*) FILTER (e > 0) AS pos, count(*) FILTER (e <> 0) AS n, count(*) FILTER (e = 0) AS zero FROM t)
    SELECT pos, n, zero, round(list_sum(list_transform(range(pos, n + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2.0)))), 6) AS p FROM s""")
def sign_test(spark, sf_dir):
    task = _means(spark, sf_dir).groupBy("task").agg(F.avg("mean_effect").alias("e"))
    s = task.agg(F.count_if(F.col("e") > 0).alias("pos"), F.count_if(F.col("e") != 0).alias("n"), F.count_if(F.col("e") == 0).alias("zero"))
    return s.select("pos", "n", "zero", F.round(stats.sign_test_p(F.col("pos"), F.col("n")), 6).alias("p"))


@query(f"""WITH c AS (SELECT task, run, max(y) FILTER (cond = 'F') AS f, max(y) FILTER (cond = 'O') AS o, max(y) FILTER (cond = 'P') AS p FROM {_ROWS} GROUP BY task, run, pool, cluster),
    d AS (SELECT 'F_vs_O' AS comparison, task, run, f - o AS d FROM c UNION ALL SELECT 'F_vs_P', task, run, f - p FROM c),
    m AS (SELECT comparison, task, run, avg(d) AS m FROM d WHERE d IS NOT NULL GROUP BY 1, 2, 3),
    e AS (SELECT comparison, avg(e) AS estimate FROM (SELECT comparison, run, avg(m) AS e FROM m GROUP BY 1, 2) GROUP BY 1),
    s AS (SELECT comparison, count(*) AS task_count, count(*) FILTER (e > 0) AS pos, count(*) FILTER (e <> 0) AS n FROM (SELECT comparison, task, avg(m) AS e FROM m GROUP BY 1, 2) GROUP BY 1),
    p AS (SELECT *, CASE WHEN n = 0 THEN 1 ELSE least(1, list_sum(list_transform(range(pos, n + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2.0))))) END AS p FROM e JOIN s USING (comparison)),
    h AS (SELECT *, max(least(1, (m - k + 1) * p)) OVER (ORDER BY p, comparison ROWS UNBOUNDED PRECEDING) AS p_holm FROM (SELECT *, row_number() OVER (ORDER BY p, comparison) AS k, count(*) OVER () AS m FROM p))
    SELECT comparison, round(estimate, 9) AS estimate, task_count, round(p, 6) AS p, round(p_holm, 6) AS p_holm, bool_and(estimate > 0 AND p_holm < 0.05) OVER () AS support FROM h""")
def planned_comparisons(spark, sf_dir):
    """One condition against each other one, with the tests' family-wise correction and the support of the hypothesis."""
    rows = _rows(spark, sf_dir)
    pairs = [stats.pair_conditions(rows, ["task", "run", "pool", "cluster"], "cond", "y", "F", c).withColumn("comparison", F.lit(f"F_vs_{c}")) for c in ("O", "P")]
    means = stats.pool_means(pairs[0].union(pairs[1]).filter("difference IS NOT NULL"), "task", "run", "pool", "difference", ("comparison",))
    out = stats.comparison_report(means, "comparison", "task", "run", "mean_effect")
    return out.select("comparison", F.round("estimate", 9).alias("estimate"), "task_count", F.round("p", 6).alias("p"), F.round("p_holm", 6).alias("p_holm"), "support")


_P = "(SELECT o_orderstatus AS family, 'c' || (o_custkey % 12) AS name, (count(*) * 7 % 101 + 1) / 400.0 AS p FROM orders GROUP BY 1, 2)"


@query(f"""WITH r AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY family) AS m FROM {_P} WINDOW w AS (PARTITION BY family ORDER BY p, name))
    SELECT family, name, round(max(least(1, (m - k + 1) * p)) OVER (PARTITION BY family ORDER BY p, name ROWS UNBOUNDED PRECEDING), 9) AS p_holm FROM r""")
def holm_adjusted(spark, sf_dir):
    """A p for each status and group of customers, taken from how many orders they have."""
    cells = read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("family"), F.concat(F.lit("c"), F.col("o_custkey") % 12).alias("name")).agg(((F.count(F.lit(1)) * 7 % 101 + 1) / 400.0).alias("p"))
    return stats.holm(cells, ["family"], "name", "p").select("family", "name", F.round("p_holm", 9).alias("p_holm"))


_LABELS = "(SELECT lang AS grp, (doc_id * 7 % 5) AS a, CASE WHEN doc_id % 4 = 0 THEN (doc_id % 5) ELSE (doc_id * 7 % 5) END AS b FROM documents)"


@query(f"""WITH p AS (SELECT * FROM {_LABELS}), t AS (SELECT grp, count(*) AS n, avg((a = b)::INT) AS po FROM p GROUP BY grp),
    e AS (SELECT x.grp, sum(x.c * y.c) AS chance FROM (SELECT grp, a, count(*) AS c FROM p GROUP BY 1, 2) x JOIN (SELECT grp, b, count(*) AS c FROM p GROUP BY 1, 2) y ON x.grp = y.grp AND x.a = y.b GROUP BY 1)
    SELECT grp, n, round(po, 9) AS raw_agreement, round((po - chance / (n * n)) / (1 - chance / (n * n)), 9) AS kappa FROM t JOIN e USING (grp)""")
def annotator_agreement(spark, sf_dir):
    a = F.col("doc_id") * 7 % 5
    p = read(spark, sf_dir, "documents").select(F.col("lang").alias("grp"), a.alias("a"), F.when(F.col("doc_id") % 4 == 0, F.col("doc_id") % 5).otherwise(a).alias("b"))
    return stats.agreement(p, ["grp"], "a", "b").select("grp", "n", F.round("raw_agreement", 9).alias("raw_agreement"), F.round("kappa", 9).alias("kappa"))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def label_cells(spark, sf_dir):
    return read(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query()
def cluster_bootstrap(spark, sf_dir):
    """95 % interval of the overall effect from 2000 seeded draws of all clusters with replacement; the generator has no DuckDB form."""
    means = stats.pool_means(_pairs(spark, sf_dir).filter("difference IS NOT NULL"), "task", "run", "pool", "difference", ("cluster",))
    sums = stats.cluster_sums(means, "cluster", "run", "mean_effect")
    clusters = sums.filter("cluster IS NOT NULL").select("cluster").distinct().collect()  # 23 at most
    draws = stats.seeded_draws(spark, [r["cluster"] for r in clusters], 2000, 20260727)
    return stats.interval(stats.bootstrap(sums, draws, "cluster", "run"))


_DRAWS = [(b, f"C{(b * 7 + k * k) % 23}", 1 + (b + k) % 2) for b in range(8) for k in range(9)]


@query(f"""WITH m AS (SELECT cluster, task, run, sum(d) / count(d) AS m FROM {_DIFFS} GROUP BY 1, 2, 3), s AS (SELECT cluster, run, sum(m) AS s, count(m) AS n FROM m GROUP BY 1, 2),
    w AS (SELECT b, cluster, sum(times) AS times FROM {refdata.values_sql(_DRAWS, 'd', 'b, cluster, times')} GROUP BY 1, 2),
    r AS (SELECT b, run, sum(s * times) / sum(n * times) AS e FROM s JOIN w USING (cluster) GROUP BY 1, 2), x AS (SELECT b, avg(e) AS effect FROM r GROUP BY b)
    SELECT round(quantile_cont(effect, 0.025), 9) AS lower, round(quantile_cont(effect, 0.975), 9) AS upper FROM x""")
def bootstrap_with_given_draws(spark, sf_dir):
    means = stats.pool_means(_pairs(spark, sf_dir).filter("difference IS NOT NULL"), "task", "run", "pool", "difference", ("cluster",))
    draws = refdata.table(spark, _DRAWS, "b int, cluster string, times int").groupBy("b", "cluster").agg(F.sum("times").alias("times"))
    out = stats.interval(stats.bootstrap(stats.cluster_sums(means, "cluster", "run", "mean_effect"), F.broadcast(draws), "cluster", "run"))
    return out.select(F.round("lower", 9).alias("lower"), F.round("upper", 9).alias("upper"))


@query("SELECT percentile::DOUBLE AS p, round(v, 6) AS v FROM (SELECT unnest([0.025, 0.5, 0.975]) AS percentile, unnest(quantile_cont(o_totalprice, [0.025, 0.5, 0.975])) AS v FROM orders)")
def percentiles(spark, sf_dir):
    prices = read(spark, sf_dir, "orders").select(F.col("o_totalprice").cast("double").alias("price"))
    return inference.quantiles(prices, "price", [0.025, 0.5, 0.975]).select("p", F.round("v", 6).alias("v"))


@query("SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS z FROM orders, (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders)")
def standardised(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    s = o.agg(F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("s"))
    return o.join(F.broadcast(s)).select("o_orderkey", F.round((F.col("o_totalprice") - F.col("m")) / F.col("s"), 6).alias("z"))


_SUPPORT = "(SELECT c_nationkey AS h, c_acctbal > -950 + 100 * (c_nationkey % 3) AS d, c_acctbal < 9900 - 5000 * (c_nationkey % 2) AS s FROM customer)"


@query(f"SELECT h, CASE WHEN bool_and(d AND s) THEN 'full' WHEN bool_or(d AND s) THEN 'partial' ELSE 'not_supported' END AS support FROM {_SUPPORT} GROUP BY h")
def support_classes(spark, sf_dir):
    nation, balance = F.col("c_nationkey"), F.col("c_acctbal")
    t = read(spark, sf_dir, "customer").select(nation.alias("h"), (balance > -950 + 100 * (nation % 3)).alias("d"), (balance < 9900 - 5000 * (nation % 2)).alias("s"))
    return t.groupBy("h").agg(stats.support_class(F.col("d"), F.col("s")).alias("support"))


@query("""SELECT CASE WHEN st IN ('O') THEN NULL WHEN ex LIKE '1%' THEN 0 ELSE (sel IN ('A', 'B'))::INT END AS correct, coalesce(nullif(g, ''), 'TASK::' || t) AS cluster, count(*) AS n
    FROM (SELECT o_orderstatus AS st, o_orderpriority AS ex, substr('ABCDE', 1 + (o_custkey % 5)::INT, 1) AS sel, CASE WHEN o_orderkey % 2 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'G1' END AS g, 'T' || (o_orderkey % 5) AS t FROM orders) GROUP BY 1, 2""")
def selection_outcomes(spark, sf_dir):
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "timeout").otherwise("accepted")
    execution = F.when(F.col("o_orderpriority").startswith("1"), "model_failure").otherwise("success")
    picked = F.substring(F.lit("ABCDE"), (1 + F.col("o_custkey") % 5).cast("int"), F.lit(1))
    correct = stats.selection_correct(status, execution, picked, F.array(F.lit("A"), F.lit("B")))
    group = F.when(k % 2 == 0, "").when(k % 3 != 0, "G1")
    cluster = stats.cluster_id(group, F.concat(F.lit("T"), (k % 5).cast("string")))
    return read(spark, sf_dir, "orders").groupBy(correct.alias("correct"), cluster.alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
