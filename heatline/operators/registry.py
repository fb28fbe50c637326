"""The 17 calculation models behind one table of field specifications, validated and executed in bulk.

``requests`` has request_id, model_code and params (map<string,string>).  Validation
joins requests with the specification (fixed size, broadcast) and applies one generic
rule set; execution evaluates scalar models as Columns over all rows at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calc, formula, refdata
from . import lookup, validation

# ---- fixed values: model code, field, type, required, default, least, largest ----
FIELDS = [
    ("A001", "value", "number", True, None, None, None),
    ("A001", "source_unit", "string", True, None, None, None),
    ("A001", "target_unit", "string", True, None, None, None),
    ("A002", "formula", "string", True, None, None, None),
    ("A003", "formula", "string", True, None, None, None),
    ("A004", "compositions", "object", True, None, None, None),
    ("A004", "tolerance", "number", False, "0.001", None, None),
    ("A005", "input_streams", "object", True, None, None, None),
    ("A005", "output_streams", "object", True, None, None, None),
    ("A005", "tolerance", "number", False, "0.001", None, None),
    ("B001", "species", "string", True, None, None, None),
    ("B001", "temperature", "number", True, "298.15", None, None),
    ("B002", "species", "string", True, None, None, None),
    ("B002", "temperature", "number", True, "298.15", None, None),
    ("B003", "species", "string", True, None, None, None),
    ("B003", "temperature_start", "number", True, "298.15", None, None),
    ("B003", "temperature_end", "number", True, "1873", None, None),
    ("B003", "mass", "number", False, "1", None, None),
    ("B004", "species", "string", True, None, None, None),
    ("B004", "temperature_start", "number", True, "298.15", None, None),
    ("B004", "temperature_end", "number", True, "1873", None, None),
    ("B005", "species", "string", True, None, None, None),
    ("B005", "temperature", "number", True, "298.15", None, None),
    ("B006", "reaction", "string", True, None, None, None),
    ("B006", "temperature", "number", False, "298.15", None, None),
    ("B007", "reaction", "string", True, None, None, None),
    ("B007", "temperature", "number", False, "298.15", None, None),
    ("B008", "reaction", "string", True, None, None, None),
    ("B008", "temperature", "number", False, "298.15", None, None),
    ("B008", "pressure", "number", False, "1", None, None),
    ("B009", "reaction", "string", True, None, None, None),
    ("B009", "temperature", "number", True, "1600", None, None),
    ("B019", "overall_composition", "number", True, None, 0, 100),
    ("B019", "phase1_composition", "number", True, None, 0, 100),
    ("B019", "phase2_composition", "number", True, None, 0, 100),
    ("C001", "A", "number", True, None, None, None),
    ("C001", "Ea", "number", True, None, None, None),
    ("C001", "temperature", "number", True, None, None, None),
    ("C001", "Ea_unit", "string", False, "J", None, None),
    ("C002", "D0", "number", True, None, None, None),
    ("C002", "Q", "number", True, None, None, None),
    ("C002", "temperature", "number", True, None, None, None),
    ("C002", "Q_unit", "string", False, "J", None, None),
]


#: Invalid inputs made for each required field, and what a reviewer fills in.
INVALID_INPUTS = 5
REVIEW_COLUMNS = ("human_decision", "human_reviewer", "reviewed_at", "human_note")


def field_rows() -> list[tuple]:
    return [(i, *r[:5], *(None if x is None else float(x) for x in r[5:])) for i, r in enumerate(FIELDS)]


def fields(spark: SparkSession) -> DataFrame:
    return refdata.table(spark, field_rows(), "ordinal int, model_code string, field string, type string, required boolean, default_value string, least double, largest double")


def tool_schemas(spec: DataFrame) -> DataFrame:
    """(name, parameters) of every model: struct<type, properties: array<struct<name, type, default>>, required: array<string>>, fields in their order."""
    own = F.struct("ordinal", F.struct(F.col("field").alias("name"), "type", F.col("default_value").alias("default")).alias("p"), "required")
    folded = spec.groupBy("model_code").agg(F.array_sort(F.collect_list(own)).alias("f"))
    properties = F.transform("f", lambda x: x["p"])
    required = F.transform(F.filter("f", lambda x: x["required"]), lambda x: x["p"]["name"])
    return folded.select(F.col("model_code").alias("name"), F.struct(F.lit("object").alias("type"), properties.alias("properties"), required.alias("required")).alias("parameters"))


def review_rows(cards: DataFrame, cases: DataFrame, findings: DataFrame) -> DataFrame:
    """Every card with its number of cases, of required fields and of invalid inputs to be made, its finding, and columns to be filled in.

    ``cards``: model_code, required (array of field names); ``cases``: model_code; ``findings``: model_code, finding.
    A card without a case has 0.  ``problem`` names what hinders a review: no finding, or more than one (the least is shown).
    """
    counts = cases.groupBy(F.col("model_code").alias("_code")).agg(F.count(F.lit(1)).alias("_cases"))
    told = findings.groupBy(F.col("model_code").alias("_told")).agg(F.min("finding").alias("finding"), F.count(F.lit(1)).alias("_findings"))
    rows = cards.join(counts, F.col("model_code") == F.col("_code"), "left").join(told, F.col("model_code") == F.col("_told"), "left")
    required = F.coalesce(F.array_size("required"), F.lit(0))
    problem = F.when(F.col("_findings").isNull(), "no finding").when(F.col("_findings") > 1, "more than one finding")
    return rows.select(
        "model_code", F.coalesce("_cases", F.lit(0)).alias("golden_case_count"), required.alias("required_field_count"), (required * INVALID_INPUTS).alias("generated_invalid_input_case_count"), "finding",
        problem.alias("problem"), *[F.lit(None).cast("string").alias(c) for c in REVIEW_COLUMNS],
    )


def validate(requests: DataFrame) -> DataFrame:
    """(request_id, rule) for everything wrong with the requests; unknown models have one rule."""
    spec = fields(requests.sparkSession)
    asked = requests.select("request_id", "model_code", "params")
    joined = asked.join(F.broadcast(spec), "model_code", "left")
    present, value = F.coalesce(F.array_contains(F.map_keys("params"), F.col("field")), F.lit(False)), F.try_element_at("params", F.col("field"))
    empty = value.isNull() | value.isin("", "{}", "[]")
    number, checked = value.try_cast("double"), present & (F.col("type") == "number") & ~(F.col("required") & empty)
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    name = F.col("field")
    rules = F.array(
        F.when(name.isNull(), F.lit("unknown model")),
        F.when(F.col("required") & (~present | empty), F.concat(name, F.lit(": missing"))),
        F.when(checked & number.isNull(), F.concat(name, F.lit(": not a number"))),
        F.when(checked & number.isNotNull() & ~finite, F.concat(name, F.lit(": not finite"))),
        F.when(checked & finite & (number < F.col("least")), F.concat(name, F.lit(": below its least value"))),
        F.when(checked & finite & (number > F.col("largest")), F.concat(name, F.lit(": above its largest value"))),
    )
    return joined.select("request_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))


def _param(name: str, default: float | None = None) -> Column:
    value = F.try_element_at("params", F.lit(name)).try_cast("double")
    return value if default is None else F.coalesce(value, F.lit(default))


def execute(requests: DataFrame) -> DataFrame:
    """request_id, model_code, status, error_code, result (map<string,double>) of every request."""
    spark = requests.sparkSession
    bad = validate(requests).groupBy("request_id").agg(F.concat_ws("; ", F.sort_array(F.collect_list("rule"))).alias("problems"))
    rows = requests.select("request_id", "model_code", "params").join(bad, "request_id", "left")
    text = lambda k: F.try_element_at("params", F.lit(k))
    species = lookup.shomate_table(spark).select(F.col("species").alias("_species"), "p", "t_min", "t_max")
    reactions = refdata.table(spark, [r[1:4] for r in refdata.reactions()], "_reaction string, dh double, ds double")
    rows = rows.join(F.broadcast(species), text("species") == F.col("_species"), "left").join(F.broadcast(reactions), text("reaction") == F.col("_reaction"), "left")
    rows = rows.withColumn("_v", _param("value")).withColumn("_su", F.coalesce(text("source_unit"), F.lit(""))).withColumn("_tu", F.coalesce(text("target_unit"), F.lit("")))
    rows = lookup.convert_units(rows, "_v", "_su", "_tu")
    weights = F.create_map(*[F.lit(x) for pair in refdata.atomic_weights() for x in pair])
    formulas = F.when(F.col("model_code").isin("A002", "A003"), text("formula"))
    rows = rows.withColumn("_f", formula.composition(formulas)["elements"])
    mass = F.aggregate(F.map_entries("_f"), F.lit(0.0), lambda acc, e: acc + e["value"] * F.element_at(weights, e["key"]))
    atoms = F.aggregate(F.map_values("_f"), F.lit(0.0), lambda acc, n: acc + n)
    composition = F.from_json(text("compositions"), "map<string,double>")

    streams = "array<struct<name:string,mass:double,elements:map<string,double>>>"
    streams_in, streams_out = F.from_json(text("input_streams"), streams), F.from_json(text("output_streams"), streams)

    t, p = _param("temperature", 298.15), F.col("p")
    t0, t1 = _param("temperature_start"), _param("temperature_end")
    inside = lambda x: x.between(F.col("t_min"), F.col("t_max"))
    g = calc.reaction_gibbs(F.col("dh"), F.col("ds"), t)
    c0, c1, c2 = (_param(x) for x in ("overall_composition", "phase1_composition", "phase2_composition"))
    k = calc.arrhenius(_param("A"), calc.joules(_param("Ea"), F.coalesce(text("Ea_unit"), F.lit("J"))), t)
    d = calc.diffusion(_param("D0"), calc.joules(_param("Q"), F.coalesce(text("Q_unit"), F.lit("J"))), t)

    def result(**values: Column) -> Column:
        return F.map_filter(F.create_map(*[x for name, v in values.items() for x in (F.lit(name), v)]), lambda _, v: v.isNotNull())

    model = F.col("model_code")
    table = {
        "A001": result(value=F.col("converted"), factor=F.col("factor")),
        "A002": result(total_atoms=atoms, molar_mass=F.round(mass, 4)),
        "A003": result(molar_mass=F.round(mass, 4)),
        "A004": calc.normalised_map(composition),
        "A005": F.when((F.size(streams_in) > 0) & (F.size(streams_out) > 0), calc.balance_result(streams_in, streams_out, _param("tolerance", 0.001))),
        "B003": F.when(inside(t0) & inside(t1), result(delta_H=F.round(calc.sensible_enthalpy(t0, t1, p, _param("mass", 1.0)), 4))),
        "B004": F.when(inside(t0) & inside(t1) & (t0 < t1), result(delta_S=F.round(calc.entropy(t1, p) - calc.entropy(t0, p), 4))),
        "B005": F.when(inside(t), result(G=F.round(calc.species_gibbs(t, p), 4))),
        "B006": result(delta_H=F.col("dh"), delta_S=F.col("ds"), delta_G=F.round(g, 2)),
        "B007": result(delta_S=F.col("ds"), delta_H=F.col("dh")),
        "B008": result(delta_G=F.round(g, 2)),
        "B009": F.when(t > 0, result(log10_K=F.round(calc.log10_equilibrium(g, t), 4), delta_G=F.round(g, 4))),
        "B019": result(phase2_fraction=F.round(calc.lever_fraction(c0, c1, c2), 6)),
        "C001": result(k=F.round(k, 10), ln_k=F.round(calc.safe_log(k), 4)),
        "C002": result(D=F.round(d, 12), diffusion_length=F.round(calc.diffusion_length(d), 8)),
    }
    shomate = F.when(inside(t), result(Cp=F.round(calc.heat_capacity(t, p), 6), H=F.round(calc.enthalpy(t, p), 4), S=F.round(calc.entropy(t, p), 4)))
    found = F.when(model.isin("B001", "B002"), shomate)
    for code, value in table.items():
        found = found.when(model == code, value)
    found = F.when(F.col("problems").isNull() & (F.size(found) > 0), found)
    lever = calc.lever_error(c0, c1, c2)
    error = (
        F.when(F.contains(F.col("problems"), F.lit("unknown model")), "UNKNOWN_MODEL").when(F.col("problems").isNotNull(), "INVALID_INPUT").when(found.isNotNull(), F.lit(None).cast("string"))
        .when(model == "A001", F.col("convert_error")).when(model == "B019", lever).when(model.isin("A002", "A003", "A004"), "INVALID_INPUT")
        .when(model.isin("B006", "B007", "B008", "B009") & F.col("dh").isNull(), "MODEL_NOT_APPLICABLE").when(model.isin("B001", "B002", "B003", "B004", "B005") & F.col("p").isNull(), "MISSING_DATA")
        .when(model == "B009", "INTERNAL_ERROR").when(model == "A005", "INVALID_INPUT").otherwise("OUT_OF_DOMAIN")
    )
    return rows.select("request_id", "model_code", validation.status(found.isNotNull(), error).alias("status"), error.alias("error_code"), found.alias("result"))
