"""Queries of contrasts, ranks, reconciliation and chains."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import chains, inference
from ..sources.tables import read
from .base import query

#: A model for each returnflag: a term for each line number, its mean as estimate, and the variance of that mean; terms share 1 % of the smaller variance.
_CELLS = "(SELECT l_returnflag AS model, 'line ' || l_linenumber AS term, avg(l_discount * 10)::DOUBLE AS value, (var_samp(l_discount * 10) / count(*))::DOUBLE AS v FROM lineitem GROUP BY 1, 2)"
_LINES = ("line 1", "line 2", "line 3", "line 4")
#: Fixed contrasts: one line less another, and a difference of differences.
_WEIGHTS = [("second_less_first", "line 2", 1.0), ("second_less_first", "line 1", -1.0), *(("difference", m, w) for m, w in zip(_LINES, (1.0, -1.0, -1.0, 1.0), strict=True)), ("unknown", "line 1", 1.0), ("unknown", "line 99", -1.0)]
_SHARED = "CASE WHEN a.term = b.term THEN a.v ELSE 0.01 * least(a.v, b.v) END"
_VALUES = ", ".join(f"('{c}', '{t}', {w})" for c, t, w in _WEIGHTS)


def _model(spark, sf_dir):
    y = F.col("l_discount").cast("double") * 10
    cells = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.concat(F.lit("line "), "l_linenumber").alias("term")).agg(F.avg(y).alias("value"), (F.var_samp(y) / F.count(F.lit(1))).alias("v"))
    a, b = cells.select("model", F.col("term").alias("row_term"), F.col("v").alias("_a")), cells.select("model", F.col("term").alias("column_term"), F.col("v").alias("_b"))
    shared = F.when(F.col("row_term") == F.col("column_term"), F.col("_a")).otherwise(0.01 * F.least("_a", "_b"))
    return cells.select("model", "term", "value"), a.join(b, "model").select("model", "row_term", "column_term", shared.alias("value"))


@query(f"""WITH c AS {_CELLS}, w(contrast, term, weight) AS (VALUES {_VALUES}),
    u AS (SELECT m.model, w.contrast, w.term, w.weight, c.value, c.v FROM (SELECT DISTINCT model FROM c) m CROSS JOIN w LEFT JOIN c USING (model, term)),
    e AS (SELECT model, contrast, sum(weight * value) AS estimate, bool_and(value IS NOT NULL) AS whole FROM u GROUP BY 1, 2),
    s AS (SELECT a.model, a.contrast, sum(a.weight * b.weight * {_SHARED}) AS variance FROM u a JOIN u b ON a.model = b.model AND a.contrast = b.contrast GROUP BY 1, 2)
    SELECT model, contrast, round(CASE WHEN whole THEN estimate END, 9) AS estimate, round(CASE WHEN whole THEN sqrt(variance) END, 9) AS std_error, round(CASE WHEN whole THEN estimate / sqrt(variance) END, 6) AS z
    FROM e JOIN s USING (model, contrast)""")
def planned_contrasts(spark, sf_dir):
    beta, covariance = _model(spark, sf_dir)
    found = inference.contrasts(beta, covariance, spark.createDataFrame(_WEIGHTS, "contrast string, term string, weight double"))
    return found.select("model", "contrast", F.round("estimate", 9).alias("estimate"), F.round("std_error", 9).alias("std_error"), F.round("z", 6).alias("z"))


@query(f"""WITH c AS {_CELLS}, w(contrast, term, weight) AS (VALUES {_VALUES}),
    u AS (SELECT c.model, w.contrast, c.term, w.weight * p AS wp, w.weight * p * (1 - p) AS slope, c.v FROM w JOIN (SELECT *, 1 / (1 + exp(-value)) AS p FROM c) c USING (term)),
    e AS (SELECT model, contrast, sum(wp) AS estimate FROM u GROUP BY 1, 2), s AS (SELECT a.model, a.contrast, sum(a.slope * b.slope * {_SHARED}) AS variance FROM u a JOIN u b ON a.model = b.model AND a.contrast = b.contrast GROUP BY 1, 2)
    SELECT model, contrast, round(estimate, 9) AS estimate, round(sqrt(variance), 9) AS std_error, round(estimate / sqrt(variance), 6) AS z FROM e JOIN s USING (model, contrast)""")
def response_contrasts(spark, sf_dir):
    """The same contrasts as differences of probabilities, each line number being a point of the grid."""
    beta, covariance = _model(spark, sf_dir)
    grid = beta.select(F.col("term").alias("point"), "term").distinct().withColumn("value", F.lit(1.0))
    weights = spark.createDataFrame(_WEIGHTS, "contrast string, point string, weight double")
    found = inference.response_contrasts(beta, covariance, grid, weights)
    return found.select("model", "contrast", F.round("estimate", 9).alias("estimate"), F.round("std_error", 9).alias("std_error"), F.round("z", 6).alias("z"))


@query("""SELECT value, n, (before + (n + 1) / 2.0)::DOUBLE AS rank FROM (
    SELECT o_totalprice::DOUBLE AS value, count(*) AS n, sum(count(*)) OVER (ORDER BY o_totalprice::DOUBLE) - count(*) AS before FROM orders GROUP BY 1)""")
def mid_ranks(spark, sf_dir):
    return inference.mid_ranks(read(spark, sf_dir, "orders").select(F.col("o_totalprice").cast("double").alias("price")), "price")


@query("""WITH d AS (SELECT (l_quantity - 25)::DOUBLE AS d FROM lineitem WHERE l_quantity <> 25), r AS (SELECT abs(d) AS a, count(*) AS n, count(*) FILTER (d > 0) AS pos, sum(count(*)) OVER (ORDER BY abs(d)) AS upto FROM d GROUP BY 1)
    SELECT sum(n)::BIGINT AS n, sum(pos * (upto - (n - 1) / 2.0))::DOUBLE AS w_plus FROM r""")
def signed_rank(spark, sf_dir):
    """Whether quantities lie above 25, over all line items."""
    found = inference.signed_rank_test(read(spark, sf_dir, "lineitem").select((F.col("l_quantity").cast("double") - 25).alias("d")), "d")
    return found.select("n", "w_plus")


_TOTALS = "(SELECT o_custkey, sum(o_totalprice::DOUBLE) AS total, count(*)::DOUBLE AS orders FROM orders GROUP BY 1)"
#: What was recorded: some customers left out, some changed, one in a hundred not finite, and some that have no orders.
_RECORDED = "CASE WHEN o_custkey % 17 = 0 THEN total + 5 WHEN o_custkey % 100 = 1 THEN 'Infinity'::DOUBLE ELSE total END"


@query(f"""WITH t AS {_TOTALS}, r AS (SELECT o_custkey, {_RECORDED} AS total, orders + (o_custkey % 19 = 0)::INT AS orders FROM t WHERE o_custkey % 13 <> 0 UNION ALL SELECT -c_custkey, 0, 0 FROM customer WHERE c_custkey % 50 = 0),
    b AS (SELECT coalesce(t.o_custkey, r.o_custkey) AS o_custkey, r.o_custkey IS NULL AS missing, t.o_custkey IS NULL AS extra, r.total AS a, t.total AS b, r.orders AS c, t.orders AS d FROM t FULL JOIN r USING (o_custkey))
    SELECT o_custkey, rule FROM (SELECT o_custkey, unnest([CASE WHEN missing THEN 'missing' END, CASE WHEN extra THEN 'unexpected' END, CASE WHEN NOT missing AND NOT extra AND isinf(a) THEN 'total: not finite' END,
        CASE WHEN NOT missing AND NOT extra AND NOT isinf(a) AND abs(a - b) > 0.01 THEN 'total: differs' END, CASE WHEN NOT missing AND NOT extra AND c <> d THEN 'orders: differs' END]) AS rule FROM b) WHERE rule IS NOT NULL""")
def reconciled_totals(spark, sf_dir):
    k = F.col("o_custkey")
    totals = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("double")).alias("total"), F.count(F.lit(1)).cast("double").alias("orders"))
    changed = F.when(k % 17 == 0, F.col("total") + 5).when(k % 100 == 1, F.lit(float("inf"))).otherwise(F.col("total"))
    recorded = totals.filter(k % 13 != 0).select("o_custkey", changed.alias("total"), (F.col("orders") + (k % 19 == 0).cast("int")).alias("orders"))
    none = read(spark, sf_dir, "customer").filter("c_custkey % 50 = 0").select((-F.col("c_custkey")).alias("o_custkey"), F.lit(0.0).alias("total"), F.lit(0.0).alias("orders"))
    return inference.reconcile(recorded.unionAll(none), totals, ["o_custkey"], {"total": 0.01, "orders": 0.0})


_LINKS = "(SELECT event_id, user_id, ts, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"


@query(f"""WITH l AS (SELECT *, p IS NOT NULL AND event_id % 11 = 3 AS cut FROM {_LINKS}),
    g AS (SELECT *, max(CASE WHEN p IS NULL OR cut THEN i END) OVER (PARTITION BY user_id ORDER BY i) AS start FROM l)
    SELECT a.event_id AS node, b.event_id AS root, a.i - a.start AS position, CASE WHEN b.cut THEN 'broken' ELSE 'ok' END AS state FROM g a JOIN g b ON a.user_id = b.user_id AND a.start = b.i""")
def record_chains(spark, sf_dir):
    """Each event names the one before it of its user; some name one that isn't there."""
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    links = read(spark, sf_dir, "events").select("event_id", before.alias("before"))
    cut = F.when(F.col("before").isNotNull() & (F.col("event_id") % 11 == 3), -F.col("before") - 1).otherwise(F.col("before"))
    return chains.chain_positions(links.withColumn("before", cut), "event_id", "before")


@query("""SELECT event_id, 'EV-' || upper(substr(sha256('{"a":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'null' END || ',"id":' || event_id || ',"props":' || replace(props, ' ', '') || '}'), 1, 20)) AS record_id FROM events""")
def record_ids(spark, sf_dir):
    """Ids of records that are written with their fields in no order and with blanks."""
    record = F.expr("""'{ "props": ' || props || ', "id" :' || event_id || ', "a": ' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'null' END || '}'""")
    return read(spark, sf_dir, "events").select("event_id", chains.record_id(record, "EV-").alias("record_id"))
