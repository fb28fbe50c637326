"""Published anchor values and the edges of every calculation operator."""

import math

import pytest
from pyspark.sql import functions as F

from heatline.functions import calc, formula, refdata
from heatline.operators import lookup, relational, stats, validation


def one(spark, **columns):
    return spark.range(1).select(*[(c if not isinstance(c, (int, float, str)) else F.lit(c)).alias(k) for k, c in columns.items()]).collect()[0]


def test_heat_capacity_anchor(spark):
    ask = spark.createDataFrame([("Fe(s)", 1000.0), ("Fe(s)", 1812.0), ("Fe(l)", 1812.0), ("Fe(s)", 200.0), ("nope", 500.0)], "species string, t double")
    got = lookup.first_in_range(ask, lookup.shomate_table(spark), on=["species"], value="t", low="t_min", high="t_max", order=["priority", "id"], payload=["p"])
    cp = [r["cp"] for r in got.select(calc.heat_capacity(F.col("t"), F.col("p")).alias("cp"), "species", "t").orderBy("t", "species").collect()]
    assert cp[:2] == [None, None] and math.isclose(cp[2], 35.47286, abs_tol=1e-5) and math.isclose(cp[3], 46.064)


def test_reaction_anchor(spark):
    r = one(spark, g=calc.reaction_gibbs(F.lit(-393.5), F.lit(2.9), F.lit(1000.0)))
    assert math.isclose(r["g"], -396.4)
    edges = spark.createDataFrame([(-10.5,), (-10.0,), (0.0,), (10.0,)], "g double").select(calc.reaction_direction(F.col("g")).alias("d")).collect()
    assert [r["d"] for r in edges] == ["strong forward", "forward", "reverse needs energy", "strong reverse"]
    r = one(spark, k=calc.equilibrium_constant(F.lit(5.0), F.lit(0.0)), l=calc.log10_equilibrium(F.lit(-1e6), F.lit(300.0)))
    assert r["k"] is None and r["l"] > 10_000


@pytest.mark.parametrize(
    ("value", "source", "target", "want", "error"),
    [
        (25.0, "°C", "K", 298.15, None), (2.5, "t", "kg", 2500.0, None), (1.0, "atm", "Pa", 101325.0, None), (1.0, "mpa", "bar", 10.0, None), (1.0, "M", "mol/m3", 1000.0, None), (32.0, "F", "C", 0.0, None),
        (1.0, "kg", "m", None, "UNIT_MISMATCH"), (1.0, "furlong", "m", None, "INVALID_INPUT"), (None, "kg", "g", None, None), (100.0, "%", "ppm", 1_000_000.0, None),
    ],
)
def test_unit_anchors(spark, value, source, target, want, error):
    df = spark.createDataFrame([(value, source, target)], "v double, s string, t string")
    r = lookup.convert_units(df, "v", "s", "t").collect()[0]
    assert r["convert_error"] == error and (r["converted"] is None if want is None else math.isclose(r["converted"], want, abs_tol=1e-9))
    if error == "UNIT_MISMATCH":
        assert lookup.convert_units(df, "v", "s", "t", strict=False).collect()[0]["converted"] is not None


def test_every_unit_resolves_to_itself(spark):
    names = spark.createDataFrame([(u[1],) for u in refdata.units()], "u string")
    assert lookup.resolve_units(names, "u", "x").filter("x_name = u").count() == len(refdata.units()) == 110


def test_formulas():
    assert formula.parse("Fe2O3") == {"Fe": 2.0, "O": 3.0}
    assert formula.parse("Ca(OH)2") == {"Ca": 1.0, "O": 2.0, "H": 2.0}
    assert formula.parse("K4[Fe(CN)6]") == {"K": 4.0, "Fe": 1.0, "C": 6.0, "N": 6.0}
    for bad in ("", None, "2H2", "Fe)", "(Fe", "Fe(]", "()2", "Qq", "Fe2O3 x", "Fe0", "H2 2"):
        with pytest.raises(ValueError):
            formula.parse(bad)


def test_molar_mass(spark):
    df = spark.createDataFrame([(1, "Fe2O3"), (2, "H2O"), (3, "bad!"), (4, None)], "k int, f string")
    got = {r["k"]: (r["total_atoms"], r["element_count"], r["molar_mass"]) for r in formula.molar_masses(df, "k", "f").collect()}
    assert got == {1: (5.0, 2, 159.687), 2: (3.0, 2, 18.015)}


def test_lever_order_of_tests(spark):
    rows = spark.createDataFrame([(30.0, 10.0, 50.0), (5.0, 10.0, 50.0), (10.0, 10.0, 10.0), (20.0, 10.0, 10.0), (None, 1.0, 2.0)], "a double, b double, c double")
    got = rows.select(calc.lever_fraction(*map(F.col, "abc")).alias("f"), calc.lever_error(*map(F.col, "abc")).alias("e")).collect()
    assert [(r["f"], r["e"]) for r in got] == [(0.5, None), (None, "OUT_OF_DOMAIN"), (None, "INVALID_INPUT"), (None, "OUT_OF_DOMAIN"), (None, None)]


def test_compositions(spark):
    rows = spark.createDataFrame([({"a": 1.0, "b": 3.0},), ({},), ({"a": -1.0, "b": 2.0},), ({"a": 0.0},), ({"a": float("inf")},), (None,)], "m map<string,double>")
    assert [r["n"] for r in rows.select(calc.normalised_map(F.col("m")).alias("n")).collect()] == [{"a": 0.25, "b": 0.75}, None, None, None, None, None]


def test_defaults_swallow_zero_and_text(spark):
    rows = spark.createDataFrame([("5",), ("0",), ("",), ("x",), (None,), ("NaN",)], "x string").select(calc.or_default(F.col("x"), 7.0).alias("d")).collect()
    assert [r["d"] for r in rows] == [5.0, 7.0, 7.0, 7.0, 7.0, 7.0]


def test_kinetics(spark):
    r = one(spark, k=calc.arrhenius(F.lit(1e6), calc.joules(F.lit(50.0), "kJ"), F.lit(1000.0)), cold=calc.arrhenius(F.lit(1.0), F.lit(1.0), F.lit(0.0)), zero=calc.safe_log(F.lit(0.0)), ev=calc.joules(F.lit(1.0), "eV"), strict=calc.joules(F.lit(1.0), "eV", strict_physics=True))
    assert math.isclose(r["k"], 1e6 * math.exp(-50000 / 8314), rel_tol=1e-12) and r["cold"] is None and r["zero"] == -math.inf
    assert r["ev"] == 1.602e-19 and 96_000 < r["strict"] < 97_000


def test_holm_and_signs(spark):
    p = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.03), ("f", "c", 0.04)], "f string, n string, p double")
    assert [round(r["p_holm"], 12) for r in stats.holm(p, ["f"], "n", "p").orderBy("n").collect()] == [0.03, 0.06, 0.06]
    rows = spark.createDataFrame([(0, 0), (3, 3), (5, 8), (0, 4), (900, 2000)], "pos bigint, n bigint")
    for alternative in ("greater", "less"):
        for r in rows.select("pos", "n", stats.sign_test_p(F.col("pos"), F.col("n"), alternative).alias("p")).collect():
            tail = range(r["pos"], r["n"] + 1) if alternative == "greater" else range(r["pos"] + 1)
            want = sum(math.comb(r["n"], k) for k in tail) / 2 ** r["n"] if r["n"] else 1.0
            assert math.isclose(r["p"], want, rel_tol=1e-6)


def test_kappa_edges(spark):
    same = spark.createDataFrame([("g", "x", "x")] * 4, "g string, a string, b string")
    assert stats.agreement(same, ["g"], "a", "b").collect()[0]["kappa"] == 1.0
    apart = spark.createDataFrame([("g", "x", "y"), ("g", "y", "x")], "g string, a string, b string")
    assert stats.agreement(apart, ["g"], "a", "b").collect()[0]["kappa"] == -1.0


def test_bootstrap_modes_agree_roughly(spark):
    rows = spark.createDataFrame([(f"C{i}", i % 3, float((i * 7 % 5) - 2)) for i in range(120)], "cluster string, run int, e double")
    sums = stats.cluster_sums(rows, "cluster", "run", "e")
    draws = [stats.seeded_draws(spark, [f"C{i}" for i in range(120)], 200, 1), stats.hashed_draws(sums.select("cluster").distinct(), "cluster", 200, 1)]
    a, b = (stats.interval(stats.bootstrap(sums, d, "cluster", "run")).collect()[0] for d in draws)
    assert abs(a["lower"] - b["lower"]) < 0.15 and abs(a["upper"] - b["upper"]) < 0.15


@pytest.mark.parametrize("bad", [None, "", "x", "inf", "NaN", "-5", "500"])
def test_number_rules(spark, bad):
    df = spark.createDataFrame([(bad,)], "v string")
    assert validation.violations(df, ["v"], validation.number_rules("v", F.col("v"), low=0, high=100)).count() == 1


def test_writes_as_plans(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, seq int")
    b = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 2)], "k int, v string, seq int")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(relational.upsert(t, b, ["k"], ["seq"])) == [(1, "a", 1), (2, "d", 3), (3, "e", 2)]
    assert rows(relational.insert_absent(t, b, ["k"], ["seq"])) == [(1, "a", 1), (2, "b", 1), (3, "e", 2)]
    new = b.filter("seq = 2").select("k", F.lit(None).cast("string").alias("v"), "seq")
    assert rows(relational.partial_update(t, new, ["k"], ["seq"])) == [(1, "a", 1), (2, "b", 2), (3, None, 2)]
    assert rows(relational.upsert(t.limit(0), b.limit(0), ["k"], ["seq"])) == []


def test_dynamic_predicates_fold_away(spark):
    df = spark.createDataFrame([("50%",), ("50x",), (None,)], "s string")
    assert df.filter(relational.all_of([relational.contains_text(F.col("s"), "0%"), None])).count() == 1
    assert df.filter(relational.all_of([None, relational.contains_text(F.col("s"), None)])).count() == 3


def test_mass_fractions_of_formulas(spark):
    asked = spark.createDataFrame([(1, "Fe2O3"), (2, "Fe0.947O"), (3, "Xx2"), (4, "O2")], "k int, f string")
    got = {(r["k"], r["element"]): (r["mass_fraction"], r["is_stoichiometric"]) for r in formula.mass_fractions(asked, "k", "f").collect()}
    assert got[(1, "Fe")] == (0.699431, True) and got[(1, "O")] == (0.300569, True) and got[(4, "O")] == (1.0, True)
    assert [got[(2, e)][1] for e in ("Fe", "O")] == [False, False] and 3 not in {k for k, _ in got}


def test_planned_comparisons_support_only_if_all_hold(spark):
    rows = [(c, f"t{t}", 0, 0.5) for c in ("a", "b") for t in range(6)]
    schema = "c string, t string, r int, e double"
    report = lambda x: {r["c"]: r for r in stats.comparison_report(spark.createDataFrame(x, schema), "c", "t", "r", "e").collect()}
    both = report(rows)
    assert both["a"]["estimate"] == 0.5 and both["a"]["task_count"] == 6 and both["a"]["p"] == pytest.approx(1 / 64)
    assert both["a"]["p_holm"] == both["b"]["p_holm"] == pytest.approx(1 / 32) and both["a"]["support"] and both["b"]["support"]
    one = report([(c, t, r, -e if c == "b" else e) for c, t, r, e in rows])
    assert one["b"]["p"] == 1 and not one["a"]["support"] and not one["b"]["support"]
    assert report(rows[:0]) == {}
