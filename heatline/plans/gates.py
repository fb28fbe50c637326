"""Queries of policies, gates and the tables that models take: labels' actions, complete repeats, missing entries, forms, eligible cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as rel
from ..operators import stats, validation
from ..sources.tables import read
from . import stats as pairs
from .base import query

#: Labels of customers and the exceptions listed for some of them, written once for both engines.
_LABEL = {
    "risk_status": "CASE WHEN c_custkey % 17 = 0 THEN 'review_required' ELSE 'normal' END",
    "answerability": "CASE c_custkey % 11 WHEN 0 THEN 'ambiguous_request' WHEN 1 THEN 'missing_task_information' ELSE 'answerable' END",
    "evidence_requirement": "CASE c_custkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'optional' WHEN 2 THEN 'required' ELSE CASE WHEN c_custkey % 8 = 3 THEN 'required' END END",
    "capability_status": "CASE WHEN c_custkey % 5 = 0 THEN 'unavailable' ELSE 'available' END",
    "information_status": "CASE WHEN c_custkey % 3 = 0 THEN 'sufficient' ELSE 'missing_execution_input' END",
}
_ACTION_SETS = (("call",), ("answer",), ("call", "answer", "call"), ("refuse",), ("clarify",), ("clarify", "answer"), (), ("guess",))


@query(f"""WITH l AS (SELECT c_custkey, {', '.join(f'{e} AS {n}' for n, e in _LABEL.items())}, {[list(a) for a in _ACTION_SETS]}::VARCHAR[][] AS sets FROM customer),
    a AS (SELECT *, list_sort(list_distinct(sets[c_custkey % {len(_ACTION_SETS)} + 1])) AS actions, CASE WHEN risk_status = 'review_required' THEN ['escalate'] WHEN answerability <> 'answerable' THEN ['clarify'] WHEN evidence_requirement = 'none' THEN ['answer']
        WHEN evidence_requirement = 'optional' THEN CASE WHEN capability_status = 'unavailable' THEN ['answer'] WHEN information_status = 'sufficient' THEN ['answer', 'call'] ELSE ['answer', 'clarify'] END
        WHEN evidence_requirement = 'required' THEN CASE WHEN capability_status = 'unavailable' THEN ['refuse'] WHEN information_status = 'sufficient' THEN ['call'] ELSE ['clarify'] END END AS defaults FROM l)
    SELECT c_custkey, array_to_string(actions, ',') AS actions, array_to_string(defaults, ',') AS defaults, CASE WHEN len(actions) = 0 THEN 'no actions' WHEN actions = ['guess'] THEN 'unknown action' WHEN defaults IS NULL THEN 'no default'
        WHEN actions = defaults THEN 'default' WHEN c_custkey % 2 = 0 AND defaults = ['clarify'] THEN 'override' ELSE 'differs' END AS outcome FROM a""")
def action_policy(spark, sf_dir):
    """Labels against the policy; even customers have an exception for when the policy says to clarify."""
    sets = F.array(*[F.array(*map(F.lit, a)).cast("array<string>") for a in _ACTION_SETS])
    own = F.get(sets, (F.col("c_custkey") % len(_ACTION_SETS)).cast("int"))
    customers = read(spark, sf_dir, "customer").select("c_custkey")
    labels = customers.select("c_custkey", *[F.expr(e).alias(n) for n, e in _LABEL.items()], own.alias("allowed_actions"))
    listed = customers.filter("c_custkey % 2 = 0").select("c_custkey", F.array(F.lit("clarify")).alias("default_actions"), own.alias("accepted_actions"))
    found = validation.action_policy(labels, listed, "c_custkey")
    return found.select("c_custkey", F.array_join("actions", ",").alias("actions"), F.array_join("defaults", ",").alias("defaults"), "outcome")


@query(f"""WITH s AS (SELECT task, run, list_sort(list(DISTINCT pool)) AS seen FROM {pairs._DIFFS} GROUP BY 1, 2)
    SELECT task, run, array_to_string(list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: NOT list_contains(seen, x)), ',') AS missing, len(list_filter(seen, lambda x: x > 'E'))::INT AS surplus FROM s WHERE seen <> ['A', 'B', 'C', 'D', 'E']""")
def incomplete_repeats(spark, sf_dir):
    """Tasks and runs whose paired effects lack a repeat."""
    found = stats.incomplete_repeats(pairs._pairs(spark, sf_dir).filter("difference IS NOT NULL"), "task", "run", "pool")
    return found.select("task", "run", F.array_join("missing", ",").alias("missing"), F.size("surplus").alias("surplus"))


_ENDED = "CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END"
_MISSING = "CASE WHEN ln = 0 THEN 'no F' WHEN rn = 0 THEN 'no O' WHEN l IS NULL OR r IS NULL THEN 'unobservable' END"


@query(f"""SELECT 'ALL' AS hypothesis, 'execution_status' AS category, count(*) AS count, to_json({{'request_status': o_orderstatus, 'execution_status': {_ENDED}}})::VARCHAR AS detail FROM orders GROUP BY o_orderstatus, {_ENDED}
    UNION ALL SELECT 'H3', 'missing_pair', 1, to_json({{'task': task, 'run': run, 'pool': pool, 'cluster': cluster, 'missing': {_MISSING}}})::VARCHAR FROM {pairs._CELLS} WHERE {_MISSING} IS NOT NULL
    UNION ALL SELECT 'H3', 'duplicate_cell', 1, to_json({{'task': task, 'run': run, 'pool': pool, 'cond': cond, 'cells': n}})::VARCHAR FROM (SELECT task, run, pool, cond, count(*) AS n FROM {pairs._ROWS} GROUP BY ALL) WHERE n > 1""")
def missing_entries(spark, sf_dir):
    """The audit in full: how requests ended, then every missing pair and every repeated cell."""
    ended = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("request_status"), F.expr(_ENDED).alias("execution_status"))
    missing = pairs._pairs(spark, sf_dir).filter("missing IS NOT NULL").select("task", "run", "pool", "cluster", "missing")
    cells = pairs._rows(spark, sf_dir).groupBy("task", "run", "pool", "cond").agg(F.count(F.lit(1)).alias("cells")).filter("cells > 1")
    return stats.missingness_rows(ended, {("H3", "missing_pair"): missing, ("H3", "duplicate_cell"): cells})


_RECORD = dict(zip(stats.MODEL_COLUMNS, (
    "o_orderkey", "CASE WHEN o_orderkey % 19 <> 0 THEN CAST(o_totalprice > 150000 AS INT) END", "o_orderstatus", "CASE o_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE o_orderpriority END",
    "o_custkey % 7", "o_custkey % 5", "o_orderpriority", "o_custkey % 3", "o_totalprice", "o_orderkey % 100", "CASE WHEN o_orderkey % 2 = 0 THEN 17 ELSE 120 END", "o_orderstatus", "o_custkey % 9",
), strict=True))


@query(f"""SELECT {', '.join("coalesce(nullif(" + e + ", ''), 'TASK::' || o_orderkey) AS " + n if n == 'minimal_pair_group' else f'{e} AS {n}' for n, e in _RECORD.items())} FROM orders WHERE o_orderkey % 19 <> 0 AND o_totalprice IS NOT NULL""")
def model_rows(spark, sf_dir):
    """What a mixed model takes of all observed records."""
    return stats.model_rows(read(spark, sf_dir, "orders").select(*[F.expr(e).alias(n) for n, e in _RECORD.items()]))


@query("""SELECT p_partkey, '{' || array_to_string(list_filter([CASE WHEN p_partkey % 3 > 0 THEN '"brand":"' || p_brand || '"' END, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '"limit":null' WHEN 2 THEN '"limit":12.5' ELSE '"limit":7' END, '"size":' || p_size], lambda x: x IS NOT NULL), ',') || '}' AS params FROM part""")
def form_parameters(spark, sf_dir):
    """Forms of parts: unfilled fields dropped, numbers read from what was typed."""
    filled = {
        "brand": "CASE p_partkey % 3 WHEN 0 THEN '' ELSE p_brand END", "size": "CAST(p_size AS STRING) || ' mm'", "note": "CASE WHEN p_partkey % 2 = 0 THEN '' END",
        "limit": "CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'none' WHEN 2 THEN ' 12.5e0' ELSE '7, or so' END",
    }
    form = F.create_map(*[x for k, e in filled.items() for x in (F.lit(k), F.expr(e))])
    params = rel.form_parameters(form, F.array(F.lit("size"), F.lit("limit")))
    # As a VARIANT object, whose fields are in order and whose numbers have one form.
    shown = F.to_json(F.parse_json(F.to_json(F.to_variant_object(params))))
    return read(spark, sf_dir, "part").select("p_partkey", shown.alias("params"))


@query("SELECT p_partkey, p_brand FROM part WHERE p_size > 10 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')")
def eligible_cases(spark, sf_dir):
    """Parts that stand both among the returned and the accepted items."""
    items = read(spark, sf_dir, "lineitem")
    flag = lambda f: items.filter(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("p_partkey"))
    return rel.eligible(read(spark, sf_dir, "part").filter("p_size > 10").select("p_partkey", "p_brand"), "p_partkey", flag("R"), flag("A"))
