"""Mass and element balances over tables of streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INPUT, OUTPUT = "input", "output"


def _side(name: str, column: Column | str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("side") == name, column)), F.lit(0.0))


def closure(inlet: Column, outlet: Column) -> Column:
    """How far what goes out meets what comes in: 1 for equal masses; nothing in counts as a base of 1."""
    return 1 - F.abs(inlet - outlet) / F.when(inlet == 0, 1.0).otherwise(inlet)


def element_balances(streams: DataFrame, key: str) -> DataFrame:
    """(key, element, input, output, residual): what every element's mass is on each side.

    ``streams`` has a row for each stream: key, side (input or output), mass and elements
    (map of element to its fraction).  Missing masses and fractions are 0.
    """
    mass = F.coalesce("mass", F.lit(0.0))
    flows = streams.select(key, "side", mass.alias("_mass"), F.explode("elements").alias("element", "_fraction"))
    flows = flows.withColumn("_x", F.col("_mass") * F.coalesce("_fraction", F.lit(0.0)))
    both = flows.groupBy(key, "element").agg(_side(INPUT, F.col("_x")).alias("input"), _side(OUTPUT, F.col("_x")).alias("output"))
    return both.withColumn("residual", F.col("input") - F.col("output"))


def balance_checks(streams: DataFrame, key: str, tolerance: float = 0.001) -> DataFrame:
    """(key, total_input_mass, total_output_mass, mass_closure_rate, max_element_residual, passed, error) for each key.

    Passed if no element's residual is beyond the tolerance, in units of mass.  A key without
    streams on one of the sides is INVALID_INPUT and has no figures.  Streams are never gathered:
    elements are summed first, and their few rows then meet the totals.
    """
    has = lambda name: F.count_if(F.col("side") == name)
    totals = streams.groupBy(key).agg(_side(INPUT, F.col("mass")).alias("_i"), _side(OUTPUT, F.col("mass")).alias("_o"), (F.least(has(INPUT), has(OUTPUT)) > 0).alias("_both"))
    worst = element_balances(streams, key).groupBy(F.col(key).alias("_key")).agg(F.max(F.abs("residual")).alias("_r"))
    rows = totals.join(worst, F.col(key).eqNullSafe(F.col("_key")), "left")
    residual = F.coalesce("_r", F.lit(0.0))
    figure = lambda c, digits: F.when(F.col("_both"), F.round(c, digits))
    return rows.select(
        key, figure(F.col("_i"), 4).alias("total_input_mass"), figure(F.col("_o"), 4).alias("total_output_mass"), figure(closure(F.col("_i"), F.col("_o")), 6).alias("mass_closure_rate"),
        figure(residual, 6).alias("max_element_residual"), F.when(F.col("_both"), residual <= tolerance).alias("passed"), F.when(~F.col("_both"), "INVALID_INPUT").alias("error"),
    )
