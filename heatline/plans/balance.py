"""Queries of compositions, balances, lever rule and process indices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calc
from ..operators import balance
from ..sources.tables import read
from .base import query


@query("""WITH c AS (SELECT l_orderkey, l_returnflag AS e, sum(l_quantity)::BIGINT AS m FROM lineitem GROUP BY 1, 2), t AS (SELECT l_orderkey, sum(m) AS total FROM c GROUP BY 1)
    SELECT l_orderkey, e AS element, round(m / total, 6) AS share, abs(total - 100)::BIGINT AS deviation FROM c JOIN t USING (l_orderkey)""")
def normalise_composition(spark, sf_dir):
    parts = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.sum("l_quantity").alias("m"))
    whole = parts.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", F.col("m").cast("double")))).alias("c"), F.sum("m").cast("long").alias("total"))
    return whole.select("l_orderkey", F.explode(calc.normalised_map(F.col("c"))).alias("element", "share"), F.abs(F.col("total") - 100).alias("deviation"))


@query("""WITH s AS (SELECT l_orderkey, l_linestatus = 'F' AS inlet, l_quantity AS m, round(l_discount, 2) AS fe, round(l_tax, 2) AS o FROM lineitem),
    e AS (SELECT l_orderkey, inlet, 'Fe' AS element, m * fe AS x FROM s UNION ALL SELECT l_orderkey, inlet, 'O', m * o FROM s),
    b AS (SELECT l_orderkey, element, coalesce(sum(x) FILTER (inlet), 0) AS i, coalesce(sum(x) FILTER (NOT inlet), 0) AS out FROM e GROUP BY 1, 2)
    SELECT l_orderkey, element, round(i, 4) AS input, round(out, 4) AS output, round(i - out, 4) AS residual, round(1 - abs(i - out) / CASE WHEN i = 0 THEN 1 ELSE i END, 9) AS closure FROM b""")
def mass_balance(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem")
    elements = F.create_map(F.lit("Fe"), F.round("l_discount", 2), F.lit("O"), F.round("l_tax", 2))
    flows = items.select("l_orderkey", (F.col("l_linestatus") == "F").alias("inlet"), "l_quantity", F.explode(elements).alias("element", "fraction")).withColumn("x", F.col("l_quantity") * F.col("fraction"))
    side = lambda c: F.coalesce(F.sum(F.when(c, F.col("x"))), F.lit(0.0))
    both = flows.groupBy("l_orderkey", "element").agg(side(F.col("inlet")).alias("i"), side(~F.col("inlet")).alias("o"))
    base = F.when(F.col("i") == 0, 1.0).otherwise(F.col("i"))
    return both.select(
        "l_orderkey", "element", F.round("i", 4).alias("input"), F.round("o", 4).alias("output"), F.round(F.col("i") - F.col("o"), 4).alias("residual"),
        F.round(1 - F.abs(F.col("i") - F.col("o")) / base, 9).alias("closure"),
    )


@query("""WITH s AS (SELECT l_orderkey AS k, l_linestatus = 'F' AS inlet, l_quantity AS m, round(l_discount, 2) AS fe, CASE WHEN l_linenumber < 3 THEN round(l_tax, 2) END AS o FROM lineitem),
    t AS (SELECT k, coalesce(sum(m) FILTER (inlet), 0)::DOUBLE AS i, coalesce(sum(m) FILTER (NOT inlet), 0)::DOUBLE AS o, bool_or(inlet) AND bool_or(NOT inlet) AS ok,
        greatest(abs(sum(CASE WHEN inlet THEN m ELSE -m END * fe)), abs(coalesce(sum(CASE WHEN inlet THEN m ELSE -m END * o), 0))) AS r FROM s GROUP BY 1)
    SELECT k AS l_orderkey, CASE WHEN ok THEN round(i, 4) END AS total_input_mass, CASE WHEN ok THEN round(o, 4) END AS total_output_mass,
        CASE WHEN ok THEN round(1 - abs(i - o) / CASE WHEN i = 0 THEN 1 ELSE i END, 6) END AS mass_closure_rate, CASE WHEN ok THEN round(r, 6) END AS max_element_residual,
        CASE WHEN ok THEN r <= 0.5005 END AS passed, CASE WHEN NOT ok THEN 'INVALID_INPUT' END AS error FROM t""")
def balance_checks(spark, sf_dir):
    """Closure, largest residual and verdict of every order's streams; the second element stands in two of them at most."""
    oxygen = F.map_filter(F.create_map(F.lit("Fe"), F.round("l_discount", 2), F.lit("O"), F.when(F.col("l_linenumber") < 3, F.round("l_tax", 2))), lambda _, v: v.isNotNull())
    side = F.when(F.col("l_linestatus") == "F", balance.INPUT).otherwise(balance.OUTPUT)
    streams = read(spark, sf_dir, "lineitem").select("l_orderkey", side.alias("side"), F.col("l_quantity").alias("mass"), oxygen.alias("elements"))
    return balance.balance_checks(streams, "l_orderkey", 0.5005)


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS c0, l_discount * 100 AS c1, 20 + l_tax * 500 AS c2 FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN c0 BETWEEN least(c1, c2) AND greatest(c1, c2) AND abs(c2 - c1) >= 1e-12 THEN round((c0 - c1) / (c2 - c1), 6) END AS f2,
        CASE WHEN c0 < least(c1, c2) OR c0 > greatest(c1, c2) THEN 'OUT_OF_DOMAIN' WHEN abs(c2 - c1) < 1e-12 THEN 'INVALID_INPUT' END AS error FROM x""")
def lever_rule(spark, sf_dir):
    c0, c1, c2 = F.col("l_quantity"), F.col("l_discount") * 100, 20 + F.col("l_tax") * 500
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(calc.lever_fraction(c0, c1, c2), 6).alias("f2"), calc.lever_error(c0, c1, c2).alias("error"))


_FURNACE = "(SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 360 ELSE 300.0 + p_size END AS coke, CASE WHEN p_size % 5 = 0 THEN 160 ELSE 100.0 + p_size END AS coal, p_retailprice AS prod FROM part)"


@query(f"""SELECT p_partkey, round(least(95, (300 / coke + 130 / coal) / 2 * 100), 4) AS efficiency, round((coke * 2.86 + coal * 2.45) * prod / 1000, 6) AS emission,
        round(1 - (coke * 2.86 + coal * 2.45) / (380 * 2.86 + 170 * 2.45), 6) AS reduction, round(least(98, 300 / coke * 100), 4) AS utilisation FROM {_FURNACE}""")
def furnace_indices(spark, sf_dir):
    number = lambda every, base: F.when(F.col("p_size") % every == 0, "").otherwise((base + F.col("p_size")).cast("string"))
    coke, coal, prod = calc.or_default(number(7, 300), 360.0), calc.or_default(number(5, 100), 160.0), F.col("p_retailprice")
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.round(calc.furnace_efficiency(coke, coal), 4).alias("efficiency"), F.round(calc.furnace_emission(coke, coal, prod), 6).alias("emission"),
        F.round(calc.furnace_reduction(coke, coal, prod), 6).alias("reduction"), F.round(calc.carbon_utilisation(coke), 4).alias("utilisation"),
    )


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS v, l_discount + 0.05 AS d, 1e-3 * (1 + l_tax) AS mu FROM lineitem), r AS (SELECT *, 1000 * (v * 0.001) * d / mu AS re FROM x)
    SELECT CASE WHEN re < 2000 THEN 'laminar' WHEN re < 4000 THEN 'transitional' ELSE 'turbulent' END AS flow, count(*) AS n, round(avg(2000 * mu / (d * 1000)), 6) AS critical FROM r GROUP BY 1""")
def reynolds_classes(spark, sf_dir):
    v, d, mu = F.col("l_quantity") * 0.001, F.col("l_discount") + 0.05, 1e-3 * (1 + F.col("l_tax"))
    flow = calc.flow_class(calc.reynolds(F.lit(1000), v, d, mu))
    return read(spark, sf_dir, "lineitem").groupBy(flow.alias("flow")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(calc.critical_velocity(F.lit(1000), d, mu)), 6).alias("critical"))


@query("""SELECT p_partkey, round(p_size / 10.0 * 8 + 0.05 * 15, 4) AS oxygen, greatest(60, least(100, 95 - p_size / 10.0 * 5 - 1.5 * 3)) AS score,
        CASE WHEN greatest(60, least(100, 95 - p_size / 10.0 * 5 - 1.5 * 3)) >= 90 THEN 'good' WHEN greatest(60, least(100, 95 - p_size / 10.0 * 5 - 1.5 * 3)) >= 80 THEN 'fair' ELSE 'poor' END AS grade FROM part""")
def converter_and_casting(spark, sf_dir):
    si = F.col("p_size") / 10.0
    score = calc.casting_score(si, F.lit(1.5))
    return read(spark, sf_dir, "part").select("p_partkey", F.round(calc.converter_oxygen(si, F.lit(0.05)), 4).alias("oxygen"), score.alias("score"), calc.casting_class(score).alias("grade"))


@query("""WITH t AS (SELECT conv_id, turn, coalesce(text, '') || ' x [调用:thermo:{"t": ' || turn || '}] y [调用 : zzz : {}] ' || role AS s FROM conversations),
    m AS (SELECT conv_id, turn, unnest(regexp_extract_all(s, '\\[调用\\s*:\\s*(\\w+)\\s*:\\s*(\\{[\\s\\S]*?\\})\\]', 1)) AS model FROM t)
    SELECT model, model = 'thermo' AS known, count(*) AS n FROM m GROUP BY 1, 2""")
def call_markers(spark, sf_dir):
    pattern = r"\[调用\s*:\s*(\w+)\s*:\s*(\{[\s\S]*?\})\]"
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(' x [调用:thermo:{"t": '), F.col("turn").cast("string"), F.lit("}] y [调用 : zzz : {}] "), F.col("role"))
    calls = read(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("model"))
    return calls.groupBy("model", (F.col("model") == "thermo").alias("known")).agg(F.count(F.lit(1)).alias("n"))
