"""Calculation operators as Columns: thermochemistry, kinetics, balances, process indices.

All are plain expressions, so they stay inside whole-stage code generation and any
filter on their inputs is pushed to the scan.  Temperatures are kelvins unless a
name says otherwise; the gas constant is 8.314 J/(mol K) throughout.  A result is
null where its inputs are null or outside the domain; ``*_error`` gives the code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import stripped

GAS_CONSTANT = 8.314


def _c(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


# ---- Shomate: heat capacity, enthalpy increment, entropy ----


def heat_capacity(t_k: Column, p: Column) -> Column:
    """Cp in J/(mol K) from a struct ``p`` with fields a to h."""
    t = t_k / 1000.0
    return p["a"] + p["b"] * t + p["c"] * t * t + p["d"] * t * t * t + p["e"] / (t * t)


def enthalpy(t_k: Column, p: Column) -> Column:
    """H - H(298) in kJ/mol."""
    t = t_k / 1000.0
    return p["a"] * t + p["b"] * t * t / 2 + p["c"] * t * t * t / 3 + p["d"] * t * t * t * t / 4 - p["e"] / t + p["f"] - p["h"]


def entropy(t_k: Column, p: Column) -> Column:
    """S in J/(mol K)."""
    t = t_k / 1000.0
    return p["a"] * F.log(t) + p["b"] * t + p["c"] * t * t / 2 + p["d"] * t * t * t / 3 - p["e"] / (2 * t * t) + p["g"]


def species_gibbs(t_k: Column, p: Column) -> Column:
    """H increment less T times absolute S, in kJ/mol, as the source tables mix them."""
    return enthalpy(t_k, p) - t_k * entropy(t_k, p) / 1000


def sensible_enthalpy(t0: Column, t1: Column, p: Column, mass: Column | float = 1.0) -> Column:
    """Closed-form enthalpy between two temperatures, times mass."""
    return (enthalpy(t1, p) - enthalpy(t0, p)) * _c(mass)


def sensible_enthalpy_trapezoid(t0: Column, t1: Column, p: Column, points: int = 1000) -> Column:
    """The same by the trapezoid rule over ``points`` temperatures, in kJ."""
    step = (t1 - t0) / (points - 1)
    ends = (heat_capacity(t0, p) + heat_capacity(t1, p)) / 2
    inner = F.aggregate(F.sequence(F.lit(1), F.lit(points - 2)), F.lit(0.0), lambda acc, k: acc + heat_capacity(t0 + step * k, p))
    return (ends + inner) * step / 1000.0


# ---- reactions ----


def reaction_gibbs(delta_h: Column, delta_s: Column, t_k: Column) -> Column:
    """kJ/mol."""
    return delta_h - t_k * delta_s / 1000


def reaction_direction(delta_g: Column) -> Column:
    """Four classes at -10, 0 and 10 kJ/mol; a value at an edge is of the upper class."""
    return F.when(delta_g < -10, "strong forward").when(delta_g < 0, "forward").when(delta_g < 10, "reverse needs energy").when(delta_g >= 10, "strong reverse")


def log10_equilibrium(delta_g: Column, t_k: Column) -> Column:
    """log10 K directly, so large exponents neither overflow nor vanish; null at or below 0 K."""
    return F.when(t_k > 0, -delta_g * 1000 / (GAS_CONSTANT * t_k * F.log(F.lit(10.0))))


def equilibrium_constant(delta_g: Column, t_k: Column) -> Column:
    return F.when(t_k > 0, F.exp(-delta_g * 1000 / (GAS_CONSTANT * t_k)))


def heat_effect(delta_h: Column) -> Column:
    return F.when(delta_h < 0, "exothermic").when(delta_h >= 0, "endothermic")


def decomposition_kelvin(delta_h: Column, delta_s: Column) -> Column:
    """Where Gibbs energy is zero."""
    return F.try_divide(delta_h, delta_s / 1000)


# ---- kinetics ----


def joules(value: Column, unit: Column | str, *, strict_physics: bool = False) -> Column:
    """J/mol from J, kJ or eV; eV is taken per particle unless ``strict_physics`` multiplies by Avogadro's number."""
    ev = 1.602e-19 * (6.02214076e23 if strict_physics else 1.0)
    unit = F.lit(unit) if isinstance(unit, str) else unit
    return F.when(unit == "J", value).when(unit == "kJ", value * 1000).when(unit == "eV", value * ev)


def arrhenius(a: Column, ea_j: Column, t_k: Column, r: float = GAS_CONSTANT) -> Column:
    return F.when(t_k > 0, a * F.exp(-ea_j / (r * t_k)))


def diffusion(d0: Column, q_j: Column, t_k: Column) -> Column:
    return arrhenius(d0, q_j, t_k)


def diffusion_length(d: Column, seconds: float = 3600.0) -> Column:
    return F.sqrt(d * seconds)


def safe_log(x: Column) -> Column:
    """ln x, minus infinity at 0."""
    return F.when(x > 0, F.log(x)).when(x == 0, F.lit(float("-inf")))


# ---- balances ----


def lever_fraction(c0: Column, c1: Column, c2: Column) -> Column:
    """Fraction of the second phase; null outside [c1, c2] and where the boundaries meet."""
    inside = (c0 >= F.least(c1, c2)) & (c0 <= F.greatest(c1, c2)) & (F.abs(c2 - c1) >= 1e-12)
    return F.when(inside, F.try_divide(c0 - c1, c2 - c1))


def lever_error(c0: Column, c1: Column, c2: Column) -> Column:
    """The interval is tested before the boundaries."""
    return F.when((c0 < F.least(c1, c2)) | (c0 > F.greatest(c1, c2)), "OUT_OF_DOMAIN").when(F.abs(c2 - c1) < 1e-12, "INVALID_INPUT")


def normalised_map(composition: Column) -> Column:
    """Shares of a map<string,double>, six decimals; null if empty, negative, non-finite or without a positive sum."""
    values = F.map_values(composition)
    bad = F.exists(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (v < 0))
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return F.when((F.size(values) > 0) & ~bad & (total > 0), F.transform_values(composition, lambda _, v: F.round(F.try_divide(v, total), 6)))


def element_mass(streams: Column, element: Column) -> Column:
    """Mass of one element in array<struct<mass, elements>>."""
    return F.aggregate(streams, F.lit(0.0), lambda acc, s: acc + F.coalesce(s["mass"], F.lit(0.0)) * F.coalesce(F.try_element_at(s["elements"], element), F.lit(0.0)))


def balance_result(inputs: Column, outputs: Column, tolerance: Column) -> Column:
    """Totals, mass closure, largest element residual and whether it is within tolerance, as map<string,double>."""
    total = lambda streams: F.aggregate(streams, F.lit(0.0), lambda acc, s: acc + F.coalesce(s["mass"], F.lit(0.0)))
    names = F.array_distinct(F.flatten(F.transform(F.concat(inputs, outputs), lambda s: F.map_keys(s["elements"]))))
    residual = F.aggregate(names, F.lit(0.0), lambda acc, e: F.greatest(acc, F.abs(element_mass(inputs, e) - element_mass(outputs, e))))
    base = F.when(total(inputs) == 0, 1.0).otherwise(total(inputs))
    return F.create_map(
        F.lit("total_input_mass"), F.round(total(inputs), 4), F.lit("total_output_mass"), F.round(total(outputs), 4), F.lit("mass_closure_rate"), F.round(1 - F.abs(total(inputs) - total(outputs)) / base, 6),
        F.lit("max_element_residual"), F.round(residual, 6), F.lit("passed"), (residual <= tolerance).cast("double"),
    )


# ---- process indices ----


def or_default(x: Column, default: float) -> Column:
    """A number from text or number; null, NaN, unreadable and 0 all become the default."""
    number = x.try_cast("double")
    return F.when(number.isNull() | F.isnan(number) | (number == 0), F.lit(default)).otherwise(number)


def furnace_efficiency(coke: Column, coal: Column) -> Column:
    return F.least(F.lit(95.0), (300 / coke + 130 / coal) / 2 * 100)


def furnace_emission(coke: Column, coal: Column, production: Column) -> Column:
    return (coke * 2.86 + coal * 2.45) * production / 1000


def furnace_reduction(coke: Column, coal: Column, production: Column) -> Column:
    bench = furnace_emission(F.lit(380.0), F.lit(170.0), production)
    return 1 - F.try_divide(furnace_emission(coke, coal, production), bench)


def carbon_utilisation(coke: Column) -> Column:
    return F.least(F.lit(98.0), 300 / coke * 100)


def converter_oxygen(silicon: Column, carbon: Column) -> Column:
    """The deterministic part of the oxygen demand."""
    return silicon * 8 + carbon * 15


def casting_score(segregation: Column, porosity: Column) -> Column:
    return F.greatest(F.lit(60.0), F.least(F.lit(100.0), 95 - segregation * 5 - porosity * 3))


def casting_class(score: Column) -> Column:
    return F.when(score >= 90, "good").when(score >= 80, "fair").otherwise("poor")


def reynolds(density: Column, velocity: Column, diameter: Column, viscosity: Column) -> Column:
    return F.try_divide(density * velocity * diameter, viscosity)


def flow_class(re: Column) -> Column:
    return F.when(re < 2000, "laminar").when(re < 4000, "transitional").when(re >= 4000, "turbulent")


def critical_velocity(density: Column, diameter: Column, viscosity: Column) -> Column:
    return F.try_divide(2000 * viscosity, diameter * density)


# ---- shared scalars ----


def is_close(actual: Column, expected: Column, rel: float | Column = 0.0, abs_tol: float | Column = 0.0) -> Column:
    bound = F.greatest(_c(rel) * F.greatest(F.abs(actual), F.abs(expected)), _c(abs_tol))
    return F.abs(actual - expected) <= bound


def jaccard(a: Column, b: Column) -> Column:
    """Two empty sets are alike."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.try_divide(F.size(F.array_intersect(a, b)), both))


def pipe_set(text: Column) -> Column:
    """The sorted distinct non-empty trimmed parts of a|b|c."""
    parts = F.transform(F.split(text, r"\|"), stripped)
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def stable_seed(key: Column) -> Column:
    """The first eight hex digits of SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint")


def display_number(x: Column) -> Column:
    """Whole numbers as they are, small ones in scientific form, others with two decimals."""
    return (
        F.when(x == F.floor(x), F.format_string("%.0f", x))
        .when(F.abs(x) < 0.01, F.format_string("%.2e", x))
        .otherwise(F.format_string("%.2f", x))
    )


def html_escape(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text
