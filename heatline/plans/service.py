"""Queries of bulk validation and execution, JSON and HTML parsing, mixed models and retrieval outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsontext, refdata
from ..operators import glmm, registry
from ..operators import relational as rel
from ..sources import html
from ..sources.tables import read
from .base import query


def _requests(spark, sf_dir):
    """Orders as requests of three models, some of them faulty."""
    k, x = F.col("o_orderkey"), F.col("o_totalprice")
    names = {r[0]: r[1] for r in refdata.reactions()}
    arrhenius = F.create_map(F.lit("A"), F.lit("1000000"), F.lit("Ea"), F.when(k % 11 == 0, "abc").otherwise("50000"), F.lit("temperature"), (300 + k % 700).cast("string"))
    gibbs = F.create_map(F.lit("reaction"), F.when(k % 5 == 0, "nothing").otherwise(F.lit(names[0])), F.lit("temperature"), (300 + k % 700).cast("string"))
    lever = F.create_map(F.lit("overall_composition"), F.floor(x % 130).cast("string"), F.lit("phase1_composition"), F.lit("10"), F.lit("phase2_composition"), F.lit("90"))
    code = F.when(k % 4 == 0, "C001").when(k % 4 == 1, "B008").when(k % 4 == 2, "B019").otherwise("Z999")
    params = F.when(k % 4 == 0, arrhenius).when(k % 4 == 1, gibbs).otherwise(lever)
    return read(spark, sf_dir, "orders").select(k.alias("request_id"), code.alias("model_code"), params.alias("params"))


_CASES = """(SELECT o_orderkey AS k, o_orderkey % 4 AS m, floor(o_totalprice % 130) AS c0, 300 + o_orderkey % 700 AS t FROM orders)"""


@query(f"""SELECT rule, count(*) AS n FROM (SELECT CASE WHEN m = 3 THEN 'unknown model' WHEN m = 0 AND k % 11 = 0 THEN 'Ea: not a number' WHEN m = 2 AND c0 > 100 THEN 'overall_composition: above its largest value' END AS rule FROM {_CASES}) WHERE rule IS NOT NULL GROUP BY rule""")
def model_validation(spark, sf_dir):
    return registry.validate(_requests(spark, sf_dir)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH r AS (SELECT k, CASE m WHEN 0 THEN 'C001' WHEN 1 THEN 'B008' WHEN 2 THEN 'B019' ELSE 'Z999' END AS model_code,
        CASE WHEN m = 3 THEN 'UNKNOWN_MODEL' WHEN m = 0 AND k % 11 = 0 THEN 'INVALID_INPUT' WHEN m = 1 AND k % 5 = 0 THEN 'MODEL_NOT_APPLICABLE' WHEN m = 2 AND c0 > 100 THEN 'INVALID_INPUT' WHEN m = 2 AND NOT c0 BETWEEN 10 AND 90 THEN 'OUT_OF_DOMAIN' END AS error_code,
        CASE m WHEN 0 THEN ln(1e6 * exp(-50000 / (8.314 * t))) WHEN 1 THEN -393.5 - t * 2.9 / 1000 WHEN 2 THEN (c0 - 10) / 80 END AS v FROM {_CASES})
    SELECT model_code, error_code, CASE WHEN error_code IS NULL THEN 'success' ELSE 'rejected' END AS status, count(*) AS n, round(avg(CASE WHEN error_code IS NULL THEN v END), 2) AS v FROM r GROUP BY 1, 2, 3""")
def model_execution(spark, sf_dir):
    done = registry.execute(_requests(spark, sf_dir))
    at = lambda k: F.try_element_at("result", F.lit(k))
    return done.groupBy("model_code", "error_code", "status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce(at("ln_k"), at("delta_G"), at("phase2_fraction"))), 2).alias("v"))


_FIELD_ROWS = [(r[1], r[4]) for r in registry.field_rows()]
_MODEL_CODES = [(code,) for code in dict.fromkeys(r[0] for r in _FIELD_ROWS)]


@query(f"""SELECT model_code, (SELECT count(*) FROM {refdata.values_sql(_FIELD_ROWS, 'f', 'code, required')} WHERE code = model_code) AS fields, (SELECT count(*) FILTER (required) FROM {refdata.values_sql(_FIELD_ROWS, 'f', 'code, required')} WHERE code = model_code) AS required, n AS requests
    FROM (SELECT model_code, count(*) AS n FROM {refdata.picked_sql(_MODEL_CODES, 'model_code', 'orders', 'o_orderkey')} GROUP BY 1)""")
def model_cards(spark, sf_dir):
    """The card of each model that orders ask for, and how many do."""
    cards = registry.fields(spark).groupBy("model_code").agg(F.count(F.lit(1)).alias("fields"), F.count_if("required").alias("required"))
    asked = refdata.picked(read(spark, sf_dir, "orders").select("o_orderkey"), _MODEL_CODES, "model_code string", "o_orderkey")
    return asked.groupBy("model_code").agg(F.count(F.lit(1)).alias("requests")).join(F.broadcast(cards), "model_code").select("model_code", "fields", "required", "requests")


def _pages(spark, sf_dir):
    """Pages made from parts: two temperature ranges each, every third page incomplete."""
    size = F.col("p_size")
    row = lambda label, *cells: F.concat(F.lit(f"<tr><th>{label}</th><td>"), *[x for i, c in enumerate(cells) for x in ([F.lit("</td><td>")] * (i > 0) + [c.cast("string")])], F.lit("</td></tr>"))
    head = F.concat(F.lit("<table class='d'><tr><th>Temperature (K)</th><td>298. to "), (1000 + size).cast("string"), F.lit("</td><td>"), (1000 + size).cast("string"), F.lit(" to 6,000.</td></tr>"))
    body = [row("A", size + 1, size + 2), *[row(x, F.lit("1.5"), F.lit("2×103")) for x in "BCDEFG"], F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(row("H", -size / 10, F.concat(F.lit("−"), (size / 10).cast("string"))))]
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("<html><table><tr><td>x</td></tr></table>"), head, *body, F.lit("</table></html>")).alias("html"))


_CARDS = refdata.values_sql(_FIELD_ROWS, "f", "code, required")


@query(f"""WITH c AS (SELECT code, count(*) FILTER (required) AS required FROM {_CARDS} GROUP BY 1),
    k AS (SELECT model_code, count(*) AS n FROM {refdata.picked_sql(_MODEL_CODES, 'model_code', 'orders', 'o_orderkey')} WHERE o_orderkey % 17 < 12 GROUP BY 1),
    f AS (SELECT model_code, min(p_name) AS finding, count(*) AS n FROM {refdata.picked_sql(_MODEL_CODES, 'model_code', 'part', 'p_partkey')} WHERE p_partkey % 17 < 9 OR p_partkey < 17 GROUP BY 1)
    SELECT code AS model_code, coalesce(k.n, 0) AS golden_case_count, required::INT AS required_field_count, (5 * required)::INT AS generated_invalid_input_case_count, finding,
        CASE WHEN f.n IS NULL THEN 'no finding' WHEN f.n > 1 THEN 'more than one finding' END AS problem, NULL::VARCHAR AS human_decision
    FROM c LEFT JOIN k ON code = k.model_code LEFT JOIN f ON code = f.model_code""")
def tool_reviews(spark, sf_dir):
    """What a reviewer of each card sees: its cases among orders, its findings among parts."""
    required = F.array_compact(F.collect_list(F.when(F.col("required"), F.col("field"))))
    cards = registry.fields(spark).groupBy("model_code").agg(required.alias("required"))
    pick = lambda df, key: refdata.picked(df, _MODEL_CODES, "model_code string", key)
    cases = pick(read(spark, sf_dir, "orders").filter("o_orderkey % 17 < 12").select("o_orderkey"), "o_orderkey")
    findings = pick(read(spark, sf_dir, "part").filter("p_partkey % 17 < 9 OR p_partkey < 17").select("p_partkey", F.col("p_name").alias("finding")), "p_partkey")
    return registry.review_rows(cards, cases, findings).drop(*registry.REVIEW_COLUMNS[1:])


@query("""SELECT p_partkey AS page_id, r AS range_no, CASE WHEN r = 1 THEN 298.0 ELSE 1000.0 + p_size END AS t_min, CASE WHEN r = 1 THEN 1000.0 + p_size ELSE 6000.0 END AS t_max, (p_size + r)::DOUBLE AS a, -p_size / 10.0 AS h
    FROM part, (VALUES (1), (2)) v(r) WHERE p_partkey % 3 <> 0""")
def html_coefficients(spark, sf_dir):
    """The ranges of all complete pages."""
    pages = _pages(spark, sf_dir)
    return html.shomate_rows(pages).select("page_id", "range_no", "t_min", "t_max", F.col("A").alias("a"), F.col("H").alias("h"))


@query("""SELECT CASE WHEN p_size % 4 = 0 THEN p_brand ELSE p_brand || '(s)' END AS species, p_partkey AS id, CASE WHEN p_size > 30 THEN 1000.0 + p_size ELSE 298.0 END AS t_min, CASE WHEN p_size > 30 THEN 6000.0 ELSE 1000.0 + p_size END AS t_max,
        (p_size + CASE WHEN p_size > 30 THEN 2 ELSE 1 END)::DOUBLE AS a FROM part WHERE p_partkey % 3 <> 0""")
def correlation_list(spark, sf_dir):
    """The range that is kept of each page, the second where the first one's H is out of proportion, as a list by species and temperature."""
    kept = html.chosen_range(html.shomate_rows(_pages(spark, sf_dir)), "page_id", limit=3.0)
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), "p_brand", F.when(F.col("p_size") % 4 != 0, "s").alias("phase"))
    rows = kept.join(parts, "page_id").select(html.species_key(F.col("p_brand"), F.col("phase")).alias("species"), F.col("page_id").alias("id"), "t_min", "t_max", F.col("A").alias("a"))
    return rel.listed(rows, ["species", "id", "t_min", "t_max", "a"], ["species", "t_min", "id"], species="")


@query("""SELECT status, count(*) AS n FROM (SELECT CASE event_id % 8 WHEN 0 THEN 'direct' WHEN 1 THEN 'fenced' WHEN 2 THEN 'embedded' WHEN 3 THEN 'ambiguous' WHEN 5 THEN 'embedded' WHEN 6 THEN 'fenced' WHEN 7 THEN 'ambiguous' ELSE 'invalid' END AS status FROM events) GROUP BY 1""")
def json_extraction(spark, sf_dir):
    p, i = F.col("props"), F.col("event_id") % 8
    fence = lambda x: F.concat(F.lit("```json\n"), x, F.lit("\n```\n"))
    text = F.when(i == 0, p).when(i == 1, F.concat(F.lit("See:\n```json\n"), p, F.lit("\n```"))).when(i == 2, F.concat(F.lit("The answer is "), p, F.lit("."))).when(i == 3, F.concat(p, F.lit(" or "), p))
    text = text.when(i == 5, F.concat(fence(F.lit("not json")), p)).when(i == 6, F.concat(fence(p), fence(F.lit("plain")))).when(i == 7, F.concat(fence(p), fence(p))).otherwise("none {")
    got = read(spark, sf_dir, "events").select(jsontext.extracted(text)["status"].alias("status"))
    return got.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, sha256('{\"a\":1,\"k\":' || json_extract(props, '$.k') || '}') AS h FROM events")
def contract_hashes(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    text = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "contract_hash": "x", "a": 1}'))
    return e.select("event_id", jsontext.hashed(text).alias("h"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'equal' WHEN 1 THEN 'approx' ELSE 'less_equal' END AS op, l_quantity AS a, 25.0 AS e FROM lineitem)
    SELECT op, count(*) AS n, count(*) FILTER (CASE op WHEN 'equal' THEN a = e WHEN 'approx' THEN abs(a - e) <= greatest(0.1 * greatest(abs(a), abs(e)), 1) ELSE a <= e + 1 END) AS passed, round(avg(abs(a - e) / greatest(abs(e), 1e-12)), 6) AS error FROM r GROUP BY op""")
def check_scoring(spark, sf_dir):
    op = F.element_at(F.array(F.lit("equal"), F.lit("approx"), F.lit("less_equal")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    a, e = F.col("l_quantity"), F.lit(25.0)
    rows = read(spark, sf_dir, "lineitem").select(op.alias("op"), jsontext.check(op, a, e, F.lit(1.0), F.lit(0.1)).alias("ok"), jsontext.normalised_error(a, e).alias("err"))
    return rows.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("passed"), F.round(F.avg("err"), 6).alias("error"))


@query()
def mixed_model(spark, sf_dir):
    """Two models over the same cells; a fit has no DuckDB form."""
    items = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("condition"), F.concat(F.lit("g"), (F.col("l_suppkey") % 12).cast("string")).alias("cluster"), (F.col("l_quantity") > 25).cast("int").alias("y"))
    cells = glmm.cells(items, ["condition"], ["cluster"], "y")
    both = cells.withColumn("model", F.explode(F.array(F.lit("h3"), F.lit("h4"))))
    return glmm.fit(both, ["condition"], ["cluster"]).select("model", "term", F.round("estimate", 3).alias("estimate"), "converged")
