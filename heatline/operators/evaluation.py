"""Properties of species at a temperature, from correlations, else from tabulated points, else from built-in coefficients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calc

# ---- fixed values: properties, their codes among the points, the order in which phases are tried ----
DEFAULT = ("cp", "entropy", "enthalpy")
CODES = {"cp": "CP_STD", "entropy": "S_STD", "enthalpy": "H_INCREMENT_298", "gibbs": "G_STD"}
PHASES = ("solid", "gas", "liquid")
#: How far a point may lie from the temperature asked for, in K; the bound itself is too far.
REACH = 1.0


def wanted(results: Column, properties: Column) -> Column:
    """Of a map of results those that are asked for; the usual ones where nothing is."""
    asked = F.coalesce(properties, F.array(*map(F.lit, DEFAULT)))
    return F.map_filter(results, lambda name, _: F.array_contains(asked, name))


def _computed(t: Column, p: Column, names: tuple[str, ...]) -> Column:
    made = {"cp": calc.heat_capacity(t, p), "entropy": calc.entropy(t, p), "enthalpy": calc.enthalpy(t, p), "gibbs": calc.species_gibbs(t, p)}
    return F.create_map(*[x for name in names for x in (F.lit(name), made[name])])


def with_correlation(requests: DataFrame, correlations: DataFrame) -> DataFrame:
    """``requests`` with ``_p``: the coefficients of the correlation that holds for species, phase and temperature.

    The species is taken without its phase in parentheses.  Phases are tried in turn, the one asked for first;
    within a phase, priority and then id decide.  Only active correlations count.
    """
    entry = F.struct("priority", "id", "phase", "t_min", "t_max", "p")
    ranges = correlations.filter("is_active").groupBy(F.col("species_id").alias("_clean")).agg(F.array_sort(F.collect_list(entry)).alias("_ranges"))
    clean = F.trim(F.substring_index("species", "(", 1))
    rows = requests.withColumn("_clean", clean).join(ranges, "_clean", "left")
    holds = F.filter("_ranges", lambda r: F.col("temperature").between(r["t_min"], r["t_max"]))
    of = lambda phase: F.get(F.filter("_holds", lambda r: r["phase"] == phase), 0)
    best = F.coalesce(of(F.col("phase")), *[of(F.lit(p)) for p in PHASES])
    return rows.withColumn("_holds", holds).withColumn("_p", best["p"]).drop("_clean", "_ranges", "_holds")


def point_results(asked: DataFrame, points: DataFrame) -> DataFrame:
    """(species, temperature, _points): for each pair asked, a map of the properties that points near by give.

    A point counts if its species begins with the one asked for and its temperature lies within reach;
    the nearest one is taken, then the least id.  Every pair is looked up once, however often it is asked, by
    whole degrees and the beginnings of names: an equal join, not one of ranges.
    """
    code = F.create_map(*[F.lit(x) for name, c in CODES.items() for x in (c, name)])
    degree = F.floor("_t")
    starts = F.transform(F.sequence(F.lit(1), F.length("_name")), lambda n: F.substring(F.col("_name"), F.lit(1), n))
    known = points.select("id", F.col("species").alias("_name"), F.col("temperature").alias("_t"), "value", code[F.col("property_code")].alias("property"))
    known = known.filter("property IS NOT NULL AND value IS NOT NULL AND length(_name) > 0 AND _t IS NOT NULL")
    known = known.withColumn("species", F.explode(starts)).withColumn("_degree", F.explode(F.sequence(degree - 1, degree + 1)))
    pairs = asked.select("species", "temperature").distinct().withColumn("_degree", F.floor("temperature"))
    far = F.abs(F.col("_t") - F.col("temperature"))
    near = pairs.join(known, ["species", "_degree"]).withColumn("_far", far).filter(F.col("_far") < REACH)
    best = near.groupBy("species", "temperature", "property").agg(F.min_by("value", F.struct("_far", "id")).alias("value"))
    return best.groupBy("species", "temperature").agg(F.map_from_entries(F.collect_list(F.struct("property", "value"))).alias("_points"))


def evaluate(requests: DataFrame, correlations: DataFrame, points: DataFrame, builtin: DataFrame) -> DataFrame:
    """``requests`` (species, phase, temperature, properties) with results (map<string,double>) and source.

    The first source that has anything wins: a correlation (which then gives only what is asked, be it nothing), points for any
    property asked, or the built-in coefficients of ``species(p)`` with the first letter of the
    phase, which always give the usual three.  Without any, results are empty and source is null.

    ``correlations``: id, species_id, phase, t_min, t_max, p, priority, is_active; ``points``: id, species, property_code,
    temperature, value; ``builtin``: species, t_min, t_max, p.
    """
    rows = with_correlation(requests, correlations)
    open_ = rows.filter(F.col("_p").isNull() & F.col("species").isNotNull() & F.col("temperature").isNotNull())
    rows = rows.join(point_results(open_, points), ["species", "temperature"], "left")
    own = builtin.groupBy(F.col("species").alias("_named")).agg(F.min(F.struct("t_min", "t_max", "p")).alias("_b"))
    named = F.concat("species", F.lit("("), F.substring("phase", 1, 1), F.lit(")"))
    rows = rows.join(own, named == F.col("_named"), "left")
    t, b = F.col("temperature"), F.col("_b")
    found = wanted(F.col("_points"), F.col("properties"))
    built = F.when(t.between(b["t_min"], b["t_max"]), _computed(t, b["p"], DEFAULT))
    by_correlation = F.when(F.col("_p").isNotNull(), wanted(_computed(t, F.col("_p"), tuple(CODES)), F.col("properties")))
    by_points = F.when(F.size(found) > 0, found)
    source = F.when(by_correlation.isNotNull(), "correlation").when(by_points.isNotNull(), "points").when(built.isNotNull(), "builtin")
    results = F.coalesce(by_correlation, by_points, built, F.create_map().cast("map<string,double>"))
    return rows.select(*[F.col(c) for c in requests.columns], results.alias("results"), source.alias("source"))
