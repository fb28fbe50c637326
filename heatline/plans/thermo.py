"""Queries of the thermochemical, kinetic and unit operators over line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calc, formula, refdata
from ..operators import evaluation, lookup
from ..sources.tables import read
from .base import query

_SHOMATE = refdata.values_sql(refdata.shomate(), "s", "sid, species, t_min, t_max, a, b, c, d, e, f, g, h")
_REACTIONS = refdata.values_sql(refdata.reactions(), "r", "rid, reaction, dh, ds, name")
_T = "(300 + 20 * l_quantity)"
_CP = "(a + b*t + c*t*t + d*t*t*t + e/(t*t))"
_H = "(a*t + b*t*t/2 + c*t*t*t/3 + d*t*t*t*t/4 - e/t + f - h)"
_S = "(a*ln(t) + b*t + c*t*t/2 + d*t*t*t/3 - e/(2*t*t) + g)"
_REQ = f"(SELECT l_orderkey, l_linenumber, {_T} AS t_k, {_T} / 1000.0 AS t, l_partkey % 36 AS sid FROM lineitem)"
_IN = f"FROM {_REQ} q JOIN {_SHOMATE} USING (sid) WHERE t_k BETWEEN t_min AND t_max"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as requests: species, temperature in K."""
    species = refdata.table(spark, [(r[0], r[1]) for r in refdata.shomate()], "sid long, species string")
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (300 + 20 * F.col("l_quantity")).alias("t_k"), (F.col("l_partkey") % 36).alias("sid"))
    return items.join(F.broadcast(species), "sid")


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.first_in_range(_requests(spark, sf_dir), lookup.shomate_table(spark), on=["species"], value="t_k", low="t_min", high="t_max", order=["priority", "id"], payload=["p"], how="inner")


def _reaction_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    reactions = refdata.table(spark, refdata.reactions(), "rid long, reaction string, dh double, ds double, name string")
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (300 + 20 * F.col("l_quantity")).alias("t_k"), (F.col("l_partkey") % 10).alias("rid"))
    return items.join(F.broadcast(reactions), "rid").withColumn("dg", calc.reaction_gibbs(F.col("dh"), F.col("ds"), F.col("t_k")))


_REACTED = f"(SELECT *, dh - t_k*ds/1000 AS dg FROM (SELECT l_orderkey, l_linenumber, {_T} AS t_k, l_partkey % 10 AS rid FROM lineitem) JOIN {_REACTIONS} USING (rid))"


@query(f"SELECT species, count(*) AS n, round(avg({_CP}), 6) AS cp, round(avg({_H}), 6) AS h, round(avg({_S}), 6) AS s {_IN} GROUP BY species")
def shomate_eval(spark, sf_dir):
    t, p = F.col("t_k"), F.col("p")
    return _evaluated(spark, sf_dir).groupBy("species").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(calc.heat_capacity(t, p)), 6).alias("cp"), F.round(F.avg(calc.enthalpy(t, p)), 6).alias("h"), F.round(F.avg(calc.entropy(t, p)), 6).alias("s")
    )


@query(f"SELECT species, round(avg({_CP}), 6) AS cp, 'evaluated by the Shomate form' AS method {_IN} GROUP BY species")
def nasa_labelled_eval(spark, sf_dir):
    return _evaluated(spark, sf_dir).groupBy("species").agg(F.round(F.avg(calc.heat_capacity(F.col("t_k"), F.col("p"))), 6).alias("cp")).withColumn("method", F.lit("evaluated by the Shomate form"))


@query(f"SELECT species, round(avg({_H} - t_k * {_S} / 1000), 6) AS g {_IN} GROUP BY species")
def species_gibbs(spark, sf_dir):
    return _evaluated(spark, sf_dir).groupBy("species").agg(F.round(F.avg(calc.species_gibbs(F.col("t_k"), F.col("p"))), 6).alias("g"))


_PAIR = f"FROM {_REQ} q JOIN {_SHOMATE} USING (sid) WHERE t_k >= t_min AND t_k + 50 <= t_max"


@query(f"""WITH x AS (SELECT species, l_linenumber AS mass, t_k / 1000.0 AS t, (t_k + 50) / 1000.0 AS u, a, b, c, d, e, f, g, h {_PAIR})
    SELECT species, round(avg((a*(u-t) + b*(u*u-t*t)/2 + c*(u*u*u-t*t*t)/3 + d*(u*u*u*u-t*t*t*t)/4 - e*(1/u-1/t)) * mass), 4) AS dh,
        round(avg(a*(ln(u)-ln(t)) + b*(u-t) + c*(u*u-t*t)/2 + d*(u*u*u-t*t*t)/3 - e*(1/(2*u*u)-1/(2*t*t))), 4) AS ds FROM x GROUP BY species""")
def sensible_heat_and_entropy(spark, sf_dir):
    t, u, p = F.col("t_k"), F.col("t_k") + 50, F.col("p")
    both = _evaluated(spark, sf_dir)
    ends = lookup.shomate_table(spark).select("species", "t_max")
    both = both.join(F.broadcast(ends), "species").filter(u <= F.col("t_max"))
    return both.groupBy("species").agg(
        F.round(F.avg(calc.sensible_enthalpy(t, u, p, F.col("l_linenumber"))), 4).alias("dh"), F.round(F.avg(calc.entropy(u, p) - calc.entropy(t, p)), 4).alias("ds")
    )


@query(f"""WITH x AS (SELECT DISTINCT species, t_k, a, b, c, d, e {_PAIR}),
    y AS (SELECT species, t_k, k, (t_k + 50.0 * k / 199) / 1000.0 AS t, a, b, c, d, e FROM x, range(200) r(k))
    SELECT species, t_k, round(sum({_CP} * CASE WHEN k IN (0, 199) THEN 0.5 ELSE 1 END) * 50.0 / 199 / 1000, 5) AS dh FROM y GROUP BY species, t_k""")
def sensible_heat_trapezoid(spark, sf_dir):
    ends = lookup.shomate_table(spark).select("species", "t_max")
    cases = _evaluated(spark, sf_dir).join(F.broadcast(ends), "species").filter(F.col("t_k") + 50 <= F.col("t_max")).select("species", "t_k", "p").distinct()
    return cases.select("species", "t_k", F.round(calc.sensible_enthalpy_trapezoid(F.col("t_k"), F.col("t_k") + 50, F.col("p"), 200), 5).alias("dh"))


@query(f"""SELECT rid, name, count(*) AS n, round(avg(dg), 6) AS dg, round(avg(-dg*1000 / (8.314*t_k*ln(10.0))), 6) AS log10_k,
        CASE WHEN min(dh) < 0 THEN 'exothermic' ELSE 'endothermic' END AS effect, count(*) FILTER (t_k > 1000) AS n_hot FROM {_REACTED} GROUP BY rid, name""")
def reaction_thermo(spark, sf_dir):
    return _reaction_items(spark, sf_dir).groupBy("rid", "name").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("dg"), 6).alias("dg"), F.round(F.avg(calc.log10_equilibrium(F.col("dg"), F.col("t_k"))), 6).alias("log10_k"),
        calc.heat_effect(F.min("dh")).alias("effect"), F.count_if(F.col("t_k") > 1000).alias("n_hot"),
    )


@query(f"""SELECT rid, CASE WHEN dg < -10 THEN 'strong forward' WHEN dg < 0 THEN 'forward' WHEN dg < 10 THEN 'reverse needs energy' ELSE 'strong reverse' END AS direction,
        count(*) AS n FROM {_REACTED} GROUP BY ALL""")
def reaction_direction(spark, sf_dir):
    return _reaction_items(spark, sf_dir).groupBy("rid", calc.reaction_direction(F.col("dg")).alias("direction")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT rid, count(*) AS n, count(*) FILTER (t_k > dh / (ds / 1000)) AS above, round(max(dh / (ds / 1000)), 4) AS decomposition_k FROM {_REACTED} WHERE ds <> 0 GROUP BY rid")
def decomposition_temperature(spark, sf_dir):
    """Of each reaction, how many items lie above the temperature at which it turns round."""
    kelvin = calc.decomposition_kelvin(F.col("dh"), F.col("ds"))
    items = _reaction_items(spark, sf_dir).filter("ds <> 0").groupBy("rid")
    return items.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("t_k") > kelvin).alias("above"), F.round(F.max(kelvin), 4).alias("decomposition_k"))


_TIER = [(0, "lo", 0.0, 200000.0, 2), (1, "mid", 50000.0, 300000.0, 1), (2, "hi", 150000.0, 500000.0, 3), (3, "top", 250000.0, 400000.0, 1)]


@query(f"""WITH j AS (SELECT o_orderkey, o_totalprice, id, tag, row_number() OVER (PARTITION BY o_orderkey ORDER BY priority, id) AS rn
        FROM orders LEFT JOIN {refdata.values_sql(_TIER, 't', 'id, tag, lo, hi, priority')} ON o_totalprice BETWEEN lo AND hi)
    SELECT o_orderkey, tag FROM j WHERE rn = 1""")
def range_join_top1(spark, sf_dir):
    ranges = refdata.table(spark, _TIER, "id int, tag string, lo double, hi double, priority int").withColumn("one", F.lit(1))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").withColumn("one", F.lit(1))
    return lookup.first_in_range(orders, ranges, on=["one"], value="o_totalprice", low="lo", high="hi", order=["priority", "id"], payload=["tag"]).select("o_orderkey", "tag")


_PHASES = [("BUILDING", "g", 1.0), ("BUILDING", "s", 2.0), ("AUTOMOBILE", "l", 3.0), ("MACHINERY", "s", 4.0), ("MACHINERY", "l", 5.0)]


@query(f"""WITH p AS (SELECT * FROM {refdata.values_sql(_PHASES, 'p', 'seg, phase, value')}),
    c AS (SELECT c_custkey, value, phase, row_number() OVER (PARTITION BY c_custkey ORDER BY CASE phase WHEN 's' THEN 0 WHEN 'g' THEN 1 ELSE 2 END NULLS LAST) AS rn
        FROM customer LEFT JOIN p ON c_mktsegment = seg)
    SELECT c_custkey, coalesce(value, CASE WHEN c_acctbal > 0 THEN 0.5 END, 9.0) AS value,
        CASE WHEN value IS NOT NULL THEN 'correlation' WHEN c_acctbal > 0 THEN 'point' ELSE 'builtin' END AS source
    FROM c JOIN customer USING (c_custkey) WHERE rn = 1""")
def ordered_fallback(spark, sf_dir):
    phases = refdata.table(spark, _PHASES, "seg string, phase string, value double")
    rank = F.when(F.col("phase") == "s", 0).when(F.col("phase") == "g", 1).otherwise(2)
    best = phases.groupBy("seg").agg(F.min_by("value", rank).alias("best"))
    rows = read(spark, sf_dir, "customer").join(F.broadcast(best), F.col("c_mktsegment") == F.col("seg"), "left")
    value, source = lookup.in_order([("correlation", F.col("best")), ("point", F.when(F.col("c_acctbal") > 0, 0.5)), ("builtin", F.lit(9.0))])
    return rows.select("c_custkey", value.alias("value"), source.alias("source"))


_EVALUATED = f"""s AS (SELECT *, split_part(species, '(', 1) AS clean, CASE split_part(species, '(', 2)[1] WHEN 's' THEN 'solid' WHEN 'g' THEN 'gas' ELSE 'liquid' END AS phase FROM {_SHOMATE}),
    r AS MATERIALIZED (SELECT row_number() OVER () AS rid, clean, phase, {_T} AS t_k,
        CASE l_linenumber % 4 WHEN 1 THEN ['gibbs'] WHEN 2 THEN ['cp', 'gibbs'] WHEN 3 THEN ['enthalpy'] ELSE ['cp', 'entropy', 'enthalpy'] END AS asked FROM lineitem JOIN s ON sid = l_partkey % 36),
    q AS (SELECT DISTINCT clean, phase, t_k FROM r),
    k AS (SELECT q.*, s.* EXCLUDE (clean, phase), t_k / 1000.0 AS t, row_number() OVER (PARTITION BY q.clean, q.phase, t_k ORDER BY CASE WHEN s.phase = q.phase THEN 0 WHEN s.phase = 'solid' THEN 1 WHEN s.phase = 'gas' THEN 2 ELSE 3 END, sid) AS n
        FROM q JOIN s ON s.clean = q.clean AND t_k BETWEEN t_min AND t_max WHERE sid < 12 AND sid % 5 <> 4),
    one AS (SELECT clean, phase, t_k, unnest([{{'p': 'cp', 'v': {_CP}}}, {{'p': 'entropy', 'v': {_S}}}, {{'p': 'enthalpy', 'v': {_H}}}, {{'p': 'gibbs', 'v': {_H} - t_k * {_S} / 1000}}]) AS x FROM k WHERE n = 1),
    p AS (SELECT p_partkey AS id, clean AS name, ['cp', 'entropy', 'enthalpy', 'gibbs', 'other'][p_partkey % 5 + 1] AS property, 300 + 20 * p_size + p_partkey % 3 * 0.4e0 AS pt, p_retailprice AS v FROM part JOIN s ON sid = 12 + p_partkey % 12),
    two AS (SELECT clean, phase, t_k, property, arg_min(v, (abs(pt - t_k), id)) AS v FROM (SELECT q.* FROM q ANTI JOIN one USING (clean, phase, t_k)) JOIN p ON starts_with(name, clean) AND abs(pt - t_k) < 1
        WHERE property <> 'other' GROUP BY ALL),
    three AS (SELECT clean, q.phase, t_k, unnest([{{'p': 'cp', 'v': {_CP}}}, {{'p': 'entropy', 'v': {_S}}}, {{'p': 'enthalpy', 'v': {_H}}}]) AS x
        FROM (SELECT *, t_k / 1000.0 AS t FROM q) q JOIN (SELECT * EXCLUDE (clean, phase) FROM s) s ON species = clean || '(' || phase[1] || ')' AND t_k BETWEEN t_min AND t_max),
    a AS (SELECT rid, 'correlation' AS source, x.p AS property, x.v AS v, list_contains(asked, x.p) AS kept FROM r JOIN one USING (clean, phase, t_k)),
    b AS (SELECT rid, 'points' AS source, property, v FROM r JOIN two USING (clean, phase, t_k) WHERE list_contains(asked, property)),
    c AS (SELECT rid, 'builtin' AS source, x.p AS property, x.v AS v FROM r JOIN three USING (clean, phase, t_k) ANTI JOIN (SELECT rid FROM a UNION SELECT rid FROM b) USING (rid)),
    e AS (SELECT rid, source, property, v FROM a WHERE kept UNION ALL FROM b UNION ALL FROM c)"""


@query(f"""WITH {_EVALUATED} SELECT source, property, count(*) AS n, round(avg(v), 6) AS mean FROM (SELECT rid FROM r) LEFT JOIN e USING (rid) GROUP BY 1, 2""")
def evaluated_properties(spark, sf_dir):
    """The properties asked for by line items: correlations of some species, points made from parts, built-in coefficients; or nothing."""
    bare, letter = F.substring_index("species", "(", 1), F.substring(F.element_at(F.split("species", r"\("), 2), 1, 1)
    phase = F.when(letter == "s", "solid").when(letter == "g", "gas").otherwise("liquid")
    some = F.col("l_linenumber") % 4
    asked = F.when(some == 1, F.array(F.lit("gibbs"))).when(some == 2, F.array(F.lit("cp"), F.lit("gibbs"))).when(some == 3, F.array(F.lit("enthalpy")))
    requests = _requests(spark, sf_dir).select(bare.alias("species"), phase.alias("phase"), F.col("t_k").alias("temperature"), asked.alias("properties"))
    built = lookup.shomate_table(spark)
    correlations = built.filter("id < 12").select("id", bare.alias("species_id"), phase.alias("phase"), "t_min", "t_max", "p", "priority", (F.col("id") % 5 != 4).alias("is_active"))
    names = built.select((F.col("id") - 12).alias("_slot"), bare.alias("species"))
    code = F.element_at(F.array(*[F.lit(c) for c in evaluation.CODES.values()], F.lit("OTHER")), (F.col("p_partkey") % 5 + 1).cast("int"))
    parts = read(spark, sf_dir, "part").withColumn("_slot", (F.col("p_partkey") % 12).cast("int")).join(names, "_slot")
    t = 300 + 20 * F.col("p_size") + F.col("p_partkey") % 3 * F.lit(0.4)
    points = parts.select(F.col("p_partkey").alias("id"), "species", code.alias("property_code"), t.alias("temperature"), F.col("p_retailprice").alias("value"))
    rows = evaluation.evaluate(requests, correlations, points, built)
    each = rows.select("source", F.explode_outer("results").alias("property", "value"))
    return each.groupBy("source", "property").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


_SPECIES_POINTS = [("C", -0.0, 5.74), ("O2", 0.0, 205.15), ("CO2", -393.52, 213.79), ("CO", -110.53, 197.66), ("FeO", -272.04, 60.75), ("Fe", 0.0, 27.32)]
_STOICH = [(1, "C", -1.0), (1, "O2", -1.0), (1, "CO2", 1.0), (2, "C", -2.0), (2, "O2", -1.0), (2, "CO", 2.0), (3, "FeO", -1.0), (3, "C", -1.0), (3, "Fe", 1.0), (3, "CO", 1.0), (4, "Xx", -1.0), (4, "Fe", 1.0)]


@query(f"""WITH q AS (SELECT o_orderkey, 1 + o_custkey % 4 AS reaction FROM orders),
    r AS (SELECT reaction, sum(n * coalesce(hf, 0)) AS dh, sum(n * coalesce(s, 0)) AS ds
        FROM {refdata.values_sql(_STOICH, 'n', 'reaction, species, n')} LEFT JOIN {refdata.values_sql(_SPECIES_POINTS, 'p', 'species, hf, s')} USING (species) GROUP BY reaction)
    SELECT reaction, count(*) AS n, round(min(CASE WHEN abs(dh) > 0.01 THEN dh ELSE -1.0 END), 4) AS dh, round(min(CASE WHEN abs(dh) > 0.01 THEN ds ELSE -1.0 END), 4) AS ds
    FROM q JOIN r USING (reaction) GROUP BY reaction""")
def reaction_from_species(spark, sf_dir):
    stoich = refdata.table(spark, _STOICH, "reaction long, species string, n double")
    points = refdata.table(spark, _SPECIES_POINTS, "species string, hf double, s double")
    sums = stoich.join(F.broadcast(points), "species", "left").groupBy("reaction").agg(F.sum(F.col("n") * F.coalesce("hf", F.lit(0.0))).alias("h"), F.sum(F.col("n") * F.coalesce("s", F.lit(0.0))).alias("e"))
    known = F.abs("h") > 0.01
    table = sums.select("reaction", F.when(known, F.col("h")).otherwise(-1.0).alias("dh"), F.when(known, F.col("e")).otherwise(-1.0).alias("ds"))
    asked = read(spark, sf_dir, "orders").select((1 + F.col("o_custkey") % 4).alias("reaction")).join(F.broadcast(table), "reaction")
    return asked.groupBy("reaction").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("dh"), 4).alias("dh"), F.round(F.min("ds"), 4).alias("ds"))


# ---- kinetics ----

_KIN = f"(SELECT l_orderkey, l_linenumber, {_T} AS t_k, 1e6 * (1 + l_tax) AS a, (40 + 100 * l_discount) AS ea, CASE l_linenumber % 2 WHEN 0 THEN 'J' ELSE 'kJ' END AS unit FROM lineitem)"


@query(f"""WITH x AS (SELECT l_linenumber, t_k, a, CASE unit WHEN 'J' THEN ea ELSE ea * 1000 END AS j FROM {_KIN})
    SELECT l_linenumber, round(avg(a * exp(-j / (8.314 * t_k))), 4) AS k, round(avg(ln(a * exp(-j / (8.314 * t_k)))), 6) AS ln_k FROM x GROUP BY l_linenumber""")
def arrhenius_rate(spark, sf_dir):
    unit = F.when(F.col("l_linenumber") % 2 == 0, "J").otherwise("kJ")
    k = calc.arrhenius(1e6 * (1 + F.col("l_tax")), calc.joules(40 + 100 * F.col("l_discount"), unit), 300 + 20 * F.col("l_quantity"))
    items = read(spark, sf_dir, "lineitem").select("l_linenumber", k.alias("k"))
    return items.groupBy("l_linenumber").agg(F.round(F.avg("k"), 4).alias("k"), F.round(F.avg(calc.safe_log(F.col("k"))), 6).alias("ln_k"))


@query(f"""WITH x AS (SELECT l_linenumber, {_T} AS t_k, 1e-4 * (1 + l_tax) AS d0, CASE l_linenumber % 3 WHEN 0 THEN (50 + l_discount) WHEN 1 THEN (50 + l_discount) * 1000 ELSE (50 + l_discount) * 1.602e-19 END AS q FROM lineitem),
    d AS (SELECT l_linenumber, d0 * exp(-q / (8.314 * t_k)) AS d FROM x)
    SELECT l_linenumber, round(avg(d) * 1e6, 6) AS d_micro, round(avg(sqrt(d * 3600)), 8) AS length FROM d GROUP BY l_linenumber""")
def diffusion_coefficient(spark, sf_dir):
    unit = F.element_at(F.array(F.lit("J"), F.lit("kJ"), F.lit("eV")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    d = calc.diffusion(1e-4 * (1 + F.col("l_tax")), calc.joules(50 + F.col("l_discount"), unit), 300 + 20 * F.col("l_quantity"))
    items = read(spark, sf_dir, "lineitem").select("l_linenumber", d.alias("d"))
    return items.groupBy("l_linenumber").agg(F.round(F.avg("d") * 1e6, 6).alias("d_micro"), F.round(F.avg(calc.diffusion_length(F.col("d"))), 8).alias("length"))


# ---- units ----

_UNITS = refdata.values_sql(refdata.units(), "u", "unit_id, name, symbol, dimension, category, factor, off, least")
_KEYS = refdata.values_sql(refdata.unit_keys(), "k", "key, tier, unit_id")
_ASK = [("°C", "K"), ("celsius", "°F"), ("mpa", "atm"), ("t", "kg"), ("M", "mol/m³"), ("kcal", "kWh"), ("%", "ppm"), ("J/(kg·K)", "kJ/(kg*K)"), ("L/min", "m3/h"), ("kg", "m"), ("nope", "K"), (" KM ", "mile")]
_ASKED = [(i, *x) for i, x in enumerate(_ASK)]
_RESOLVED = f"(SELECT key, tier, u.* FROM {_KEYS} JOIN {_UNITS} USING (unit_id))"


def _unit_lookup(column: str) -> str:
    return f"(SELECT aid, r.* FROM (SELECT aid, r.*, row_number() OVER (PARTITION BY aid ORDER BY tier) AS rn FROM ask JOIN r ON (tier < 2 AND key = trim({column})) OR (tier = 2 AND key = lower(trim({column})))) r WHERE rn = 1)"


@query(f"""WITH r AS (SELECT key, tier, unit_id, name, dimension, category, factor, off, least FROM {_RESOLVED}), ask AS (SELECT * FROM {refdata.values_sql(_ASKED, 'a', 'aid, source, target')}),
    s AS (SELECT * FROM {_unit_lookup('source')}), t AS (SELECT * FROM {_unit_lookup('target')}),
    c AS (SELECT aid, s.factor AS sf, s.off AS so, t.factor AS tf, t.off AS t_off, s.category AS cat, s.least AS least,
        CASE WHEN s.aid IS NULL OR t.aid IS NULL THEN 'INVALID_INPUT' WHEN s.dimension <> t.dimension THEN 'UNIT_MISMATCH' END AS err FROM ask LEFT JOIN s USING (aid) LEFT JOIN t USING (aid)),
    x AS (SELECT c.*, l_quantity - 10 AS v FROM lineitem JOIN c ON aid = l_partkey % {len(_ASK)})
    SELECT aid::BIGINT AS ask_id, count(*) AS n, round(sum(CASE WHEN err IS NULL THEN (v * sf + so - t_off) / tf END), 3) AS converted,
        round(min(CASE WHEN err IS NULL THEN sf / tf END), 9) AS factor, min(CASE WHEN sf IS NOT NULL AND tf IS NOT NULL THEN cat END) AS category, min(err) AS convert_error, count(*) FILTER (v < least) AS below_least
    FROM x GROUP BY aid""")
def unit_conversion(spark, sf_dir):
    asked = refdata.table(spark, _ASKED, "ask_id long, source string, target string").withColumn("one_unit", F.lit(1.0))
    # Units are resolved for the few pairs asked for; the conversion itself is arithmetic on the line items.
    pairs = lookup.resolve_units(lookup.resolve_units(asked, "source", "s"), "target", "t")
    known, same = F.col("s_name").isNotNull() & F.col("t_name").isNotNull(), F.col("s_dimension") == F.col("t_dimension")
    pairs = pairs.withColumn("convert_error", F.when(~known, "INVALID_INPUT").when(~same, "UNIT_MISMATCH"))
    items = read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % len(_ASK)).alias("ask_id"), (F.col("l_quantity") - 10).alias("v"))
    x = items.join(F.broadcast(pairs), "ask_id")
    si = F.col("v") * F.col("s_factor") + F.col("s_offset")
    fine = F.col("convert_error").isNull()
    return x.groupBy("ask_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.when(fine, (si - F.col("t_offset")) / F.col("t_factor"))), 3).alias("converted"), F.round(F.min(F.when(fine, F.col("s_factor") / F.col("t_factor"))), 9).alias("factor"),
        F.min(F.when(known, F.col("s_category"))).alias("category"), F.min("convert_error").alias("convert_error"), F.count_if(F.col("v") < F.col("s_least")).alias("below_least"),
    )


@query(f"SELECT category, count(*) AS n, count(DISTINCT name) AS units, min(l_quantity::DOUBLE * factor) AS least, max(l_quantity::DOUBLE * factor) AS largest FROM {refdata.picked_sql(refdata.units(), 'unit_id, name, symbol, dimension, category, factor, off, least', 'lineitem', 'l_partkey')} GROUP BY category")
def units_by_category(spark, sf_dir):
    """Quantities in all units, by the units' category: how many, and the least and largest in its base unit."""
    items = refdata.picked(read(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity"), refdata.units(), "unit_id int, name string, symbol string, dimension string, category string, factor double, offset double, least double", "l_partkey")
    base = F.col("l_quantity").cast("double") * F.col("factor")
    return items.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("units"), F.min(base).alias("least"), F.max(base).alias("largest"))


# ---- formulas ----

_FORMULAS = [
    (0, "Fe2O3", 5.0, 2, 159.687), (1, "CaCO3", 5.0, 3, 100.086), (2, "Ca(OH)2", 5.0, 3, 74.092), (3, "K4[Fe(CN)6]", 17.0, 4, 368.345), (4, "Al2(SO4)3", 17.0, 3, 342.132),
    (5, "H2O", 3.0, 2, 18.015), (6, "Fe0.947O", 1.947, 2, 68.8842), (7, "Fe2O3)", None, None, None), (8, "2H2O", None, None, None), (9, "Xx2", None, None, None), (10, "Fe()2", None, None, None), (11, "", None, None, None),
]


@query(f"""SELECT p_size % 12 AS fid, count(*) AS n, min(atoms) AS atoms, min(elements)::BIGINT AS elements, min(mass) AS mass
    FROM part JOIN {refdata.values_sql(_FORMULAS, 'f', 'fid, formula, atoms, elements, mass')} ON fid = p_size % 12 GROUP BY 1""")
def formula_parse(spark, sf_dir):
    asked = refdata.table(spark, [(f[0], f[1]) for f in _FORMULAS], "fid int, formula string")
    masses = formula.molar_masses(asked, "fid", "formula")
    parts = read(spark, sf_dir, "part").select((F.col("p_size") % 12).alias("fid")).groupBy("fid").agg(F.count(F.lit(1)).alias("n"))
    return parts.join(F.broadcast(masses), "fid", "left").select("fid", "n", F.round("total_atoms", 6).alias("atoms"), F.col("element_count").alias("elements"), F.col("molar_mass").alias("mass"))


#: Atoms of each valid formula above, counted by hand.
_ATOMS = [
    (0, "Fe", 2.0), (0, "O", 3.0), (1, "Ca", 1.0), (1, "C", 1.0), (1, "O", 3.0), (2, "Ca", 1.0), (2, "O", 2.0), (2, "H", 2.0), (3, "K", 4.0), (3, "Fe", 1.0), (3, "C", 6.0), (3, "N", 6.0),
    (4, "Al", 2.0), (4, "S", 3.0), (4, "O", 12.0), (5, "H", 2.0), (5, "O", 1.0), (6, "Fe", 0.947), (6, "O", 1.0),
]


@query(f"""WITH a AS (SELECT fid, element, n, n * weight AS m FROM {refdata.values_sql(_ATOMS, 'a', 'fid, element, n')} JOIN {refdata.values_sql(refdata.atomic_weights(), 'w', 'element, weight')} USING (element)),
    f AS (SELECT fid, element, round(m / sum(m) OVER (PARTITION BY fid), 6) AS fraction, bool_and(n = floor(n)) OVER (PARTITION BY fid) AS whole FROM a)
    SELECT element, whole AS is_stoichiometric, count(*) AS n, round(sum(p_retailprice * fraction), 2) AS mass FROM part JOIN f ON fid = p_size % 12 GROUP BY 1, 2""")
def formula_mass_fractions(spark, sf_dir):
    """Every part's price, as a mass of its formula, divided over the formula's elements."""
    asked = refdata.table(spark, [(f[0], f[1]) for f in _FORMULAS], "fid int, formula string")
    parts = read(spark, sf_dir, "part").select((F.col("p_size") % 12).alias("fid"), "p_retailprice")
    rows = parts.join(F.broadcast(formula.mass_fractions(asked, "fid", "formula")), "fid")  # the formulas are the 12 above
    return rows.groupBy("element", "is_stoichiometric").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("p_retailprice").cast("double") * F.col("mass_fraction")), 2).alias("mass"))


@query(f"SELECT symbol, count(*) AS n, round(sum(p_size * weight), 4) AS mass FROM {refdata.picked_sql(refdata.atomic_weights(), 'symbol, weight', 'part', 'p_partkey')} GROUP BY symbol")
def element_table(spark, sf_dir):
    """Parts as moles of an element each, in grams."""
    parts = refdata.picked(read(spark, sf_dir, "part").select("p_partkey", "p_size"), refdata.atomic_weights(), "symbol string, weight double", "p_partkey")
    return parts.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("p_size") * F.col("weight")), 4).alias("mass"))


@query(f"SELECT symbol, count(*) AS n, sum(p_size * v)::BIGINT AS charge, min(v) AS lowest, max(v) AS highest FROM {refdata.picked_sql(refdata.valences(), 'symbol, v', 'part', 'p_partkey')} GROUP BY symbol")
def valence_table(spark, sf_dir):
    """Parts as ions, with their charges."""
    parts = refdata.picked(read(spark, sf_dir, "part").select("p_partkey", "p_size"), refdata.valences(), "symbol string, v int", "p_partkey")
    return parts.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("p_size") * F.col("v")).alias("charge"), F.min("v").alias("lowest"), F.max("v").alias("highest"))
