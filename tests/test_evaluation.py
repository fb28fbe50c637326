"""Evaluation over three sources against a version written out row by row."""

import math
import random

from pyspark.sql import functions as F

from heatline.operators import evaluation

P = "struct<a double,b double,c double,d double,e double,f double,g double,h double>"
REQUESTS = "id int, species string, phase string, temperature double, properties array<string>"
CORRELATIONS = f"id int, species_id string, phase string, t_min double, t_max double, p {P}, priority int, is_active boolean"
POINTS = "id int, species string, property_code string, temperature double, value double"
BUILTIN = f"species string, t_min double, t_max double, p {P}"


def coefficients(a):
    return (float(a), 1.0, 0.5, 0.25, 0.125, -3.0, 7.0, 2.0)


def computed(t_k, p, names):
    a, b, c, d, e, f, g, h = p
    t = t_k / 1000
    cp = a + b * t + c * t**2 + d * t**3 + e / t**2
    enthalpy = a * t + b * t**2 / 2 + c * t**3 / 3 + d * t**4 / 4 - e / t + f - h
    entropy = a * math.log(t) + b * t + c * t**2 / 2 + d * t**3 / 3 - e / (2 * t**2) + g
    return {k: v for k, v in {"cp": cp, "entropy": entropy, "enthalpy": enthalpy, "gibbs": enthalpy - t_k * entropy / 1000}.items() if k in names}


def expected(request, correlations, points, builtin):
    _, species, phase, t, properties = request
    asked = ["cp", "entropy", "enthalpy"] if properties is None else properties
    if species is None or t is None:
        return {}, None
    for p in (phase, "solid", "gas", "liquid"):
        fits = sorted((c[6], c[0], c) for c in correlations if c[1] == species.split("(")[0].strip() and c[2] == p and c[3] <= t <= c[4] and c[7])
        if fits:
            return computed(t, fits[0][2][5], asked), "correlation"
    found = {}
    for name in asked:
        near = sorted((abs(p[3] - t), p[0], p[4]) for p in points if species and p[1].startswith(species) and p[2] == evaluation.CODES.get(name) and abs(p[3] - t) < 1)
        if near:
            found[name] = near[0][2]
    if found:
        return found, "points"
    for name, low, high, p in builtin:
        if phase and name == f"{species}({phase[0]})" and low <= t <= high:
            return computed(t, p, evaluation.DEFAULT), "builtin"
    return {}, None


def test_sources_in_their_order(spark):
    draw = random.Random(5)
    names = ["Fe", "FeO", "Fe(s)", "CO", "CO2", "Ag", "", None]
    codes = [*evaluation.CODES.values(), "OTHER"]
    requests = [
        (i, draw.choice(names), draw.choice(["solid", "gas", "liquid", "plasma", None]), draw.choice([298.15, 300.0, 299.0, 301.5, 1200.0, 5000.0, None]),
         draw.choice([None, [], ["gibbs"], ["cp", "gibbs"], ["nothing"], ["enthalpy", "entropy"]])) for i in range(400)
    ]
    correlations = [(i, draw.choice(["Fe", "CO"]), draw.choice(evaluation.PHASES), draw.choice([298.0, 300.0]), draw.choice([300.0, 1200.0]), coefficients(i), draw.choice([0, 1]), draw.random() < 0.7) for i in range(8)]
    points = [(i, draw.choice(["Fe", "FeO", "Fe2O3", "CO2", "Ag"]), draw.choice(codes), draw.choice([298.15, 299.0, 299.9, 300.99, 301.0, 1200.5]), float(i)) for i in range(60)]
    builtin = [("FeO(s)", 298.0, 1650.0, coefficients(50)), ("Ag(l)", 1000.0, 6000.0, coefficients(60)), ("Ag(s)", 298.0, 1300.0, coefficients(70))]
    got = evaluation.evaluate(spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(correlations, CORRELATIONS), spark.createDataFrame(points, POINTS), spark.createDataFrame(builtin, BUILTIN)).collect()
    assert len(got) == len(requests)
    seen = set()
    for row in got:
        results, source = expected(requests[row["id"]], correlations, points, builtin)
        assert row["source"] == source and row["results"].keys() == results.keys(), row
        assert all(math.isclose(row["results"][k], v, rel_tol=1e-12) for k, v in results.items())
        seen.add(source)
    assert seen == {"correlation", "points", "builtin", None}


def test_without_rows(spark):
    empty = [spark.createDataFrame([], s) for s in (CORRELATIONS, POINTS, BUILTIN)]
    assert evaluation.evaluate(spark.createDataFrame([], REQUESTS), *empty).count() == 0
    row = evaluation.evaluate(spark.createDataFrame([(1, "Fe", "solid", 300.0, None)], REQUESTS).withColumn("value", F.lit("clash")), *empty).first()
    assert (row["results"], row["source"], row["value"]) == ({}, None, "clash")
