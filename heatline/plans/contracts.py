"""Queries of experiment contracts, pairings and aggregates; TPC-H rows stand for recorded experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import refdata
from ..operators import contracts, stats, validation
from ..sources.tables import read
from .base import query

_L = "l_orderkey, l_linenumber"


def _pick(key: str, options: tuple):
    """One option by the remainder of a column; None is a null."""
    kind = next(type(o) for o in options if o is not None)
    lits = [F.lit(o).cast("string" if kind is str else "int") for o in options]
    return F.element_at(F.array(*lits), (F.expr(key) % len(options) + 1).cast("int"))


def _pick_sql(key: str, options: tuple) -> str:
    return f"([{', '.join(map(refdata.literal, options))}])[({key}) % {len(options)} + 1]"


_FIELDS = {
    "task_id": ("l_partkey", ("t1", "t2", "", "t3", None, "t4", "t5", "t6", "t7")), "minimal_pair_group": ("l_suppkey", (None, "g1", " ", "g2", "g3")), "target_tool_family": ("l_partkey + l_suppkey", ("f", "f", "f", "f", "f", "f", " ")),
    "tool_pool_id": ("l_suppkey", ("p1", "p2", "p3", "p4", None, "p5")), "pool_family_id": ("l_orderkey", ("x", "y", "z")), "method": ("l_orderkey", contracts.METHODS), "pool_repeat": ("l_partkey", (*contracts.POOL_REPEATS, "F", None)),
    "model_run_repeat": ("l_linenumber", (1, 2, 0, 3, None)), "tool_pool_size": ("l_suppkey", (*contracts.POOL_SIZES, 20, None)), "pool_design": ("l_orderkey", (*contracts.POOL_DESIGNS, "other", None)),
    "near_neighbor_type": ("l_partkey", (*contracts.NEIGHBOURS, None, "far")), "near_neighbor_count": ("l_suppkey + l_linenumber", (0, 4, 8, 5, -1, None)), "selected_tool": ("l_orderkey + l_linenumber", ("a", None, "", "b")),
    "request_status": ("l_linenumber", ("accepted", "not_accepted", "accepted", "lost", None)), "execution_status": ("l_partkey + l_linenumber", (*contracts.EXECUTIONS, None, "strange")), "difficulty_score": ("l_suppkey", (0, 5, 6, None, -1)),
    "schema_token_count": ("l_partkey", (10, -1, None)),
}
_RECORDS = f"""r AS (SELECT {_L}, {', '.join(f'{_pick_sql(k, o)} AS {name}' for name, (k, o) in _FIELDS.items())},
    ([['a'], ['a', 'b'], ['a', 'a'], [''], []::VARCHAR[], NULL])[l_orderkey % 6 + 1] AS acceptable_tools, ([true, false, NULL])[l_suppkey % 3 + 1] AS end_to_end_correct FROM lineitem)"""


def _records(spark, sf_dir):
    tools = F.array(*[F.array(*map(F.lit, x)).cast("array<string>") if x is not None else F.lit(None).cast("array<string>") for x in (("a",), ("a", "b"), ("a", "a"), ("",), (), None)])
    right = F.element_at(F.array(F.lit(True), F.lit(False), F.lit(None).cast("boolean")), (F.col("l_suppkey") % 3 + 1).cast("int"))
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", *[_pick(k, o).alias(name) for name, (k, o) in _FIELDS.items()], F.element_at(tools, (F.col("l_orderkey") % 6 + 1).cast("int")).alias("acceptable_tools"), right.alias("end_to_end_correct")
    )


def _blank(c: str) -> str:
    return f"coalesce(trim({c}) = '', true)"


def _not_in(c: str, allowed: tuple) -> str:
    return f"NOT coalesce({c} IN ({', '.join(map(refdata.literal, allowed))}), false)"


_RULES = [
    *[(f"{c}: must be a non-empty string", _blank(c)) for c in ("task_id", "target_tool_family", "tool_pool_id", "pool_family_id", "method")],
    *[(f"{c}: must be null or a non-empty string", f"{c} IS NOT NULL AND {_blank(c)}") for c in ("minimal_pair_group", "selected_tool")],
    ("acceptable_tools: must contain unique non-empty strings", "acceptable_tools IS NULL OR len(acceptable_tools) = 0 OR list_contains(acceptable_tools, '') OR len(list_distinct(acceptable_tools)) < len(acceptable_tools)"),
    ("pool_repeat: unsupported", _not_in("pool_repeat", contracts.POOL_REPEATS)), ("model_run_repeat: must be 1 or more", "coalesce(model_run_repeat < 1, true)"), ("tool_pool_size: unsupported", _not_in("tool_pool_size", contracts.POOL_SIZES)),
    ("pool_design: unsupported", _not_in("pool_design", contracts.POOL_DESIGNS)), ("near_neighbor_type: unsupported", _not_in("near_neighbor_type", contracts.NEIGHBOURS)), ("near_neighbor_count: must be 0 or more", "coalesce(near_neighbor_count < 0, true)"),
    ("request_status: unsupported", _not_in("request_status", ("accepted", "not_accepted"))), ("execution_status: unsupported", "execution_status = 'strange'"),
    ("not accepted: execution_status must be null", "request_status = 'not_accepted' AND execution_status IS NOT NULL"), ("not accepted: selected_tool must be null", "request_status = 'not_accepted' AND selected_tool IS NOT NULL"),
    ("not accepted: end_to_end_correct must be null", "request_status = 'not_accepted' AND end_to_end_correct IS NOT NULL"), ("accepted: execution_status is missing", "request_status = 'accepted' AND execution_status IS NULL"),
    ("failed execution: cannot be correct", "execution_status NOT IN ('success', 'strange') AND end_to_end_correct"), ("difficulty_score: must be 0 to 5", "difficulty_score NOT BETWEEN 0 AND 5"), ("schema_token_count: must be 0 or more", "schema_token_count < 0"),
    ("controlled dose: none takes no neighbours", "pool_design = 'controlled_dose' AND near_neighbor_type = 'none' AND near_neighbor_count <> 0"),
    ("controlled dose: lexical and functional take 4 or 8", "pool_design = 'controlled_dose' AND near_neighbor_type IN ('lexical', 'functional_overlap') AND near_neighbor_count NOT IN (4, 8)"),
    ("controlled dose: cannot be mixed", "pool_design = 'controlled_dose' AND near_neighbor_type = 'mixed'"), ("mixed realistic: must be mixed", "pool_design = 'mixed_realistic' AND near_neighbor_type <> 'mixed'"),
]


@query(f"WITH {_RECORDS}, f AS (SELECT {_L}, unnest([{', '.join(f'CASE WHEN {c} THEN {refdata.literal(n)} END' for n, c in _RULES)}]) AS rule FROM r) SELECT {_L}, rule FROM f WHERE rule IS NOT NULL")
def analysis_records(spark, sf_dir):
    """Every violation of every record."""
    return validation.violations(_records(spark, sf_dir), ["l_orderkey", "l_linenumber"], contracts.record_rules())


@query(f"WITH {_RECORDS} SELECT task_id, tool_pool_id, method, model_run_repeat, count(*) AS cells FROM r WHERE task_id IS NOT NULL AND tool_pool_id IS NOT NULL AND method IS NOT NULL AND model_run_repeat IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) > 1")
def repeated_cells(spark, sf_dir):
    key = ["task_id", "tool_pool_id", "method", "model_run_repeat"]
    return contracts.repeated_cells(_records(spark, sf_dir).dropna(subset=key), key)


_CATEGORY = _pick_sql("p_size", (*contracts.CATEGORIES[:5], "odd"))


@query(f"""WITH c AS (SELECT p_partkey % 150 AS case_id, {_CATEGORY} AS category, p_partkey % 7 AS k FROM part), g AS (SELECT category, count(*) AS found FROM c GROUP BY 1), d AS (SELECT unnest({list(contracts.CATEGORIES)}) AS category),
    s AS (SELECT coalesce(g.category, d.category) AS subject, CASE WHEN d.category IS NULL THEN 'category: unknown' WHEN found IS NULL THEN 'category: no case' WHEN found <> 10 THEN 'category: declared coverage differs' END AS rule FROM g FULL JOIN d ON g.category = d.category)
    SELECT case_id::VARCHAR AS subject, 'case_id: stands more than once' AS rule FROM c GROUP BY case_id HAVING count(*) > 1 UNION ALL SELECT subject, rule FROM s WHERE rule IS NOT NULL
    UNION ALL SELECT 'dataset', 'case_count: differs' FROM c HAVING count(*) <> 120 UNION ALL SELECT case_id::VARCHAR, 'actions: must not be empty' FROM c WHERE k IN (0, 1) UNION ALL SELECT case_id::VARCHAR, 'answer_type: unsupported' FROM c WHERE k IN (5, 6)""")
def dataset_contract(spark, sf_dir):
    """Parts as tool-calling cases against a declared count and coverage."""
    k = F.col("p_partkey") % 7
    actions = F.when(k == 0, F.array().cast("array<string>")).when(k > 1, F.array(F.lit("call")))
    cases = read(spark, sf_dir, "part").select((F.col("p_partkey") % 150).alias("case_id"), _pick("p_size", (*contracts.CATEGORIES[:5], "odd")).alias("category"), actions.alias("actions"), _pick("p_partkey", (*contracts.ANSWER_TYPES, "song", None)).alias("answer_type"))
    declared = spark.createDataFrame([(c, 10) for c in contracts.CATEGORIES], "category string, n long")
    return contracts.dataset_violations(cases, declared, 120)


_TASKS = """t AS (SELECT p_partkey AS task, ['A003', 'B019', 'Z999'][p_size % 3 + 1] AS tool_id, 'h' || (p_partkey % 5) AS task_hash, p_partkey % 4 AS k, ['fraction', 'percent', 'mole', NULL][p_size % 4 + 1] AS basis FROM part),
    j AS (SELECT *, CASE WHEN tool_id <> 'Z999' THEN 'h1' END AS contract_hash, tool_id <> 'Z999' AS ok FROM t)"""


@query(f"""WITH {_TASKS}, f AS (SELECT task, unnest([CASE WHEN NOT ok THEN 'source tool is not verified' END, CASE WHEN ok AND task_hash <> contract_hash THEN 'contract hash differs' END, CASE WHEN ok AND k = 1 THEN 'acceptable tools are not the source alone' END,
        CASE WHEN ok AND k = 2 THEN 'condition pair' END, CASE WHEN ok AND k IN (0, 3) AND task % 8 >= 4 THEN 'no scoring checks' END, CASE WHEN ok AND tool_id = 'B019' AND NOT coalesce(basis IN ('fraction', 'percent'), false) THEN 'B019 needs a composition basis' END]) AS rule FROM j)
    SELECT rule, count(*) AS n FROM f WHERE rule IS NOT NULL GROUP BY 1""")
def task_contract(spark, sf_dir):
    k, key = F.col("p_partkey") % 4, F.col("p_partkey")
    tool = _pick("p_size", ("A003", "B019", "Z999"))
    tasks = read(spark, sf_dir, "part").select(
        key.alias("task"), tool.alias("tool_id"), F.concat(F.lit("h"), (key % 5).cast("string")).alias("task_hash"), F.when(k == 1, F.array(tool, F.lit("x"))).otherwise(F.array(tool)).alias("acceptable_tools"),
        F.when(k == 2, F.array(*map(F.lit, contracts.CONDITIONS[::-1]))).otherwise(F.array(*map(F.lit, contracts.CONDITIONS))).alias("conditions"), F.when(k.isin(0, 3) & (key % 8 >= 4), 0).otherwise(2).alias("checks"),
        _pick("p_size", ("fraction", "percent", "mole", None)).alias("basis"),
    )
    known = spark.createDataFrame([("A003", "verified_core", "h1"), ("B019", "verified_core", "h1"), ("Z999", "draft", "h1")], "tool_id string, contract_status string, contract_hash string")
    found = validation.violations(tasks.join(F.broadcast(known), "tool_id", "left"), ["task"], contracts.task_rules())
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT c_custkey, c_custkey % 6 AS k, c_nationkey % 5 AS m FROM customer),
    f AS (SELECT c_custkey, unnest([CASE WHEN k = 0 OR m = 0 THEN 'identity is incomplete' END, CASE WHEN k = 1 THEN 'times need a zone' END, CASE WHEN k = 2 THEN 'completed before starting' END, CASE WHEN m IN (1, 2) THEN 'no allowed actions' END, CASE WHEN m = 3 THEN 'no reason' END]) AS rule FROM a)
    SELECT c_custkey, rule FROM f WHERE rule IS NOT NULL""")
def annotation_contract(spark, sf_dir):
    k, m = F.col("c_custkey") % 6, F.col("c_nationkey") % 5
    rows = read(spark, sf_dir, "customer").select(
        "c_custkey", F.when(k > 0, "A").alias("annotator_name"), F.when(m > 0, "expert").otherwise(" ").alias("annotator_role"), F.when(k == 1, "2026-07-01T10:00:00").otherwise("2026-07-01T10:00:00+08:00").alias("started_at"),
        F.when(k == 2, "2026-07-01T02:59:00+01:00").otherwise("2026-07-01T02:30:00Z").alias("completed_at"), F.when(m == 1, F.array().cast("array<string>")).when(m != 2, F.array(F.lit("call"))).alias("allowed_actions"), F.when(m == 3, "").otherwise("why").alias("action_reason"),
    )
    return validation.violations(rows, ["c_custkey"], contracts.annotation_rules())


_SIZES = "(SELECT l_partkey AS task, l_suppkey % 4 AS m, l_linenumber AS run, CASE l_orderkey % 3 WHEN 0 THEN 17 WHEN 1 THEN 120 ELSE 50 END AS size, CASE WHEN l_returnflag <> 'R' THEN (l_quantity > 25)::INT END AS ok FROM lineitem)"
_SCALE = f"""p AS (SELECT task, m, run, count(*) FILTER (size = 17) AS c17, count(*) FILTER (size = 120) AS c120, max(CASE WHEN size = 17 THEN ok END) AS s, max(CASE WHEN size = 120 THEN ok END) AS l FROM {_SIZES} GROUP BY 1, 2, 3),
    d AS (SELECT task, m, run, CASE WHEN c120 = 0 THEN 'no 120' WHEN c17 = 0 THEN 'no 17' WHEN s IS NULL OR l IS NULL THEN 'unobservable' END AS missing, l - s AS difference FROM p WHERE c17 + c120 > 0)"""


def _scale_pairs(spark, sf_dir):
    size = F.when(F.col("l_orderkey") % 3 == 0, "17").when(F.col("l_orderkey") % 3 == 1, "120").otherwise("50")
    ok = F.when(F.col("l_returnflag") != "R", (F.col("l_quantity") > 25).cast("int"))
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("task"), (F.col("l_suppkey") % 4).alias("m"), F.col("l_linenumber").alias("run"), size.alias("size"), ok.alias("ok"))
    return stats.pair_conditions(rows, ["task", "m", "run"], "size", "ok", "120", "17")


@query(f"WITH {_SCALE} SELECT task, m, run, missing, CASE WHEN missing IS NULL THEN difference END AS difference FROM d")
def scale_pairs(spark, sf_dir):
    """The large pool less the small one on the same key; pools of other sizes are left out."""
    return _scale_pairs(spark, sf_dir).select("task", "m", "run", "missing", "difference")


@query(f"""WITH {_SCALE}, e AS (SELECT task, run, m, difference FROM d WHERE missing IS NULL), u AS (SELECT task, run, max(CASE WHEN m = 0 THEN difference END) AS h, max(CASE WHEN m = 1 THEN difference END) AS b1, max(CASE WHEN m = 2 THEN difference END) AS b2, max(CASE WHEN m = 3 THEN difference END) AS b3 FROM e GROUP BY 1, 2)
    SELECT task, run, NULL AS baseline, 'hierarchical' AS missing, NULL::DOUBLE AS difference FROM u WHERE h IS NULL
    UNION ALL SELECT task, run, x.name, CASE WHEN x.v IS NULL THEN x.name END, (h - x.v)::DOUBLE FROM (SELECT task, run, h, unnest([{{'name': 'full_schema', 'v': b1}}, {{'name': 'lexical_top5', 'v': b2}}, {{'name': 'dense_top5', 'v': b3}}]) AS x FROM u WHERE h IS NOT NULL)""")
def method_contrasts(spark, sf_dir):
    """One method against three baselines within each unit of the scale pairs."""
    effects = _scale_pairs(spark, sf_dir).filter("missing IS NULL").withColumn("method", F.element_at(F.array(*map(F.lit, contracts.METHODS)), (F.col("m") + 1).cast("int")))
    return contracts.method_contrasts(effects, ["task", "run"], "method", "difference")


@query("""WITH t AS (SELECT l_suppkey % 10 AS family, l_partkey AS task, avg(CASE WHEN l_returnflag = 'A' THEN (l_quantity > 20)::INT END) AS l, avg(CASE WHEN l_returnflag = 'N' THEN (l_quantity > 20)::INT END) AS r FROM lineitem GROUP BY 1, 2)
    SELECT family, count(*) AS task_count, count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) AS complete_tasks, round(avg(CASE WHEN r IS NOT NULL THEN l END), 6) AS mean_left, round(avg(CASE WHEN l IS NOT NULL THEN r END), 6) AS mean_right, round(avg(r - l), 6) AS mean_difference FROM t GROUP BY 1""")
def family_means(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("family"), F.col("l_partkey").alias("task"), "l_returnflag", (F.col("l_quantity") > 20).alias("ok"))
    return contracts.family_means(rows, "family", "task", "l_returnflag", "ok", "A", "N")


@query("""WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN ['call', 'answer', 'clarify'][c_custkey % 3 + 1] END AS a, CASE WHEN c_custkey % 7 <> 0 THEN ['call', 'answer'][c_custkey % 2 + 1] END AS b, CASE WHEN c_custkey % 4 = 0 THEN 'refuse' END AS h FROM customer)
    SELECT c_custkey, coalesce(h, CASE WHEN a = b THEN a END) AS label, CASE WHEN h IS NOT NULL THEN 'human_override' WHEN a = b THEN 'ai_consensus' WHEN a IS NULL OR b IS NULL THEN 'incomplete' ELSE 'unresolved' END AS provenance FROM x""")
def adjudicated_labels(spark, sf_dir):
    c, k = read(spark, sf_dir, "customer").select("c_custkey"), F.col("c_custkey")
    a = c.filter(k % 5 != 0).withColumn("label", _pick("c_custkey", ("call", "answer", "clarify")))
    b = c.filter(k % 7 != 0).withColumn("label", _pick("c_custkey", ("call", "answer")))
    return contracts.adjudicated(c, a, b, c.filter(k % 4 == 0).withColumn("label", F.lit("refuse")), "c_custkey")


#: Two annotators' labels and sets by customer, the segment being the field.
_ANNOTATED = """(SELECT c_custkey, c_mktsegment AS field, CASE WHEN c_custkey % 9 < 5 THEN 'y' ELSE 'n' END AS a, CASE WHEN c_custkey % 9 < 5 OR c_custkey % 90 = 8 THEN 'y' ELSE 'n' END AS b FROM customer)"""
_SETS = """(SELECT c_custkey, c_mktsegment AS field, CASE c_custkey % 4 WHEN 0 THEN [] WHEN 1 THEN ['x'] ELSE ['x', 'y'] END AS a, CASE WHEN c_custkey % 12 = 7 THEN ['z'] WHEN c_custkey % 4 = 0 THEN [] WHEN c_custkey % 4 = 1 THEN ['x'] ELSE ['y', 'x', 'y'] END AS b FROM customer)"""


def _annotated(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("field"))
    k, arr = F.col("c_custkey"), lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    core = c.select("*", F.when(k % 9 < 5, "y").otherwise("n").alias("a"), F.when((k % 9 < 5) | (k % 90 == 8), "y").otherwise("n").alias("b"))
    plain = lambda last: F.when(k % 4 == 0, arr()).when(k % 4 == 1, arr("x")).otherwise(last)
    return core, c.select("*", plain(arr("x", "y")).alias("a"), F.when(k % 12 == 7, arr("z")).otherwise(plain(arr("y", "x", "y"))).alias("b"))


@query(f"""WITH m AS (SELECT field, avg((a = b)::INT) AS raw, avg((a = 'y')::INT) AS ay, avg((b = 'y')::INT) AS b_y FROM {_ANNOTATED} GROUP BY 1),
    k AS (SELECT field, raw, (raw - ay * b_y - (1 - ay) * (1 - b_y)) / (1 - ay * b_y - (1 - ay) * (1 - b_y)) AS kappa FROM m),
    j AS (SELECT field, avg(CASE WHEN len(a) + len(b) = 0 THEN 1 ELSE len(list_intersect(a, b)) / len(list_distinct(a || b)) END) AS v FROM {_SETS} GROUP BY 1),
    g AS (SELECT field, 'kappa' AS measure, kappa AS value, kappa >= 0.75 AS passes FROM k UNION ALL SELECT field, 'raw_agreement', raw, raw >= 0.7 FROM k UNION ALL SELECT field, 'mean_jaccard', v, v >= 0.8 FROM j)
    SELECT field, measure, round(value, 6) AS value, passes FROM g UNION ALL SELECT NULL, 'overall', NULL, bool_and(passes) FROM g""")
def agreement_gates(spark, sf_dir):
    """Three gates by field, and the verdict over all."""
    return contracts.agreement_gates(*_annotated(spark, sf_dir)).select("field", "measure", F.round("value", 6).alias("value"), "passes")


@query(f"""SELECT c_custkey, CASE WHEN x.a <> x.b THEN x.field ELSE '' END AS core_fields, CASE WHEN list_sort(list_distinct(s.a)) <> list_sort(list_distinct(s.b)) THEN x.field ELSE '' END AS set_fields
    FROM {_ANNOTATED} x JOIN {_SETS} s USING (c_custkey) WHERE x.a <> x.b OR list_sort(list_distinct(s.a)) <> list_sort(list_distinct(s.b))""")
def annotator_disagreements(spark, sf_dir):
    found = contracts.disagreements(*_annotated(spark, sf_dir), "c_custkey")
    return found.select("c_custkey", F.array_join("core_fields", ",").alias("core_fields"), F.array_join("set_fields", ",").alias("set_fields"))


#: Experiments from line items, written once for both engines; null where a metric doesn't apply.
_RUN = {
    "mode": "l_linestatus",
    "completed": "l_tax > 0.01",
    "sequence_recall": "(l_linenumber % 3) / 2.0",
    "calls": "l_linenumber % 4",
    "ineffective": "CAST(l_linenumber % 4 > 1 AS INT)",
    "unsuccessful": "CAST(l_linenumber % 4 > 2 AS INT)",
    "unnecessary": "(l_suppkey % 2) * (l_linenumber % 4)",
    "duplicate": "CAST(l_linenumber = 7 AS INT)",
    "candidates": "CASE WHEN l_partkey % 7 < 6 THEN l_partkey % 6 END",
    "fallback": "CASE WHEN l_partkey % 5 < 4 THEN l_partkey % 6 = 5 END",
    "tokens": "CASE WHEN l_suppkey % 3 < 2 THEN l_partkey END",
    "latency": "l_quantity",
} | {m: f"CASE WHEN l_linenumber <> {i % 7 + 1} THEN l_quantity > {3 * i + 5} END" for i, m in enumerate(contracts.METRICS)}
_RUNS = "r AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _RUN.items()) + " FROM lineitem)"
_PER_CALL = ", ".join(f"CASE WHEN sum(calls) > 0 THEN round(sum({c}) / sum(calls), 4) ELSE 0 END AS {c}_rate" for c in ("ineffective", "unsuccessful", "unnecessary", "duplicate"))


@query(f"""WITH {_RUNS} SELECT mode, count(*) AS experiment_count, count(*) FILTER (completed) AS completed_count, count(*) FILTER (NOT completed) AS failed_count,
    round(avg(completed::INT), 4) AS completion_rate, count(semantic_case_passed) AS scored_count, count(*) FILTER (semantic_case_passed IS NULL) AS manual_count,
    {', '.join(f'round(avg({m}::INT), 4) AS {m}_rate' for m in contracts.METRICS)},
    round(avg(sequence_recall), 4) AS average_sequence_recall, round(sum(calls) / count(*), 4) AS average_calls, {_PER_CALL},
    round(avg(coalesce(candidates, 0)), 4) AS average_candidates, round(avg(coalesce(fallback, false)::INT), 4) AS fallback_rate, round(avg((coalesce(candidates, 0) = 0)::INT), 4) AS empty_rate,
    coalesce(sum(tokens), 0)::BIGINT AS total_tokens, round(avg(latency), 3) AS average_latency FROM r GROUP BY 1""")
def run_aggregate(spark, sf_dir):
    """All rates of recorded experiments by mode."""
    runs = read(spark, sf_dir, "lineitem").select(*[F.expr(e).alias(n) for n, e in _RUN.items()])
    return runs.groupBy("mode").agg(*contracts.run_aggregate())
