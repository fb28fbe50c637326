"""Chemical formulas: a grammar that Columns can't express, parsed in Arrow batches."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import refdata

_TOKEN = re.compile(r"([A-Z][a-z]?)|(\d+(?:\.\d+)?)|([(\[{])|([)\]}])")
_CLOSES = {"(": ")", "[": "]", "{": "}"}
RESULT = "struct<elements:map<string,double>,error:string>"


def parse(formula: str | None) -> dict[str, float]:
    """Element counts; ValueError for anything the grammar doesn't take whole."""
    text = (formula or "").strip()
    if not text:
        raise ValueError("empty formula")
    known = dict(refdata.atomic_weights())
    stack: list[tuple[str, dict[str, float]]] = [("", {})]
    last: dict[str, float] | None = None
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected character {text[at]!r}")
        element, number, opened, closed = m.groups()
        if number:
            if last is None:
                raise ValueError("a number without anything before it")
            if float(number) <= 0:
                raise ValueError("a multiplier of zero")
            for k, n in last.items():
                stack[-1][1][k] = stack[-1][1].get(k, 0.0) + n * (float(number) - 1)
            last = None
        elif element:
            if element not in known:
                raise ValueError(f"unknown element {element}")
            last = {element: 1.0}
            stack[-1][1][element] = stack[-1][1].get(element, 0.0) + 1.0
        elif opened:
            stack.append((opened, {}))
            last = None
        else:
            kind, inner = stack.pop()
            if not stack or _CLOSES[kind] != closed:
                raise ValueError("brackets don't match")
            if not inner:
                raise ValueError("an empty group")
            for k, n in inner.items():
                stack[-1][1][k] = stack[-1][1].get(k, 0.0) + n
            last = inner
        at = m.end()
    if len(stack) > 1:
        raise ValueError("brackets don't match")
    return stack[0][1]


def composition(formula: Column) -> Column:
    """struct(elements, error): exactly one is null."""

    @F.arrow_udf(RESULT)
    def run(column: pa.Array) -> pa.Array:
        seen: dict[str | None, dict] = {}
        for text in column.unique().to_pylist():
            try:
                seen[text] = {"elements": list(parse(text).items()), "error": None}
            except ValueError as e:
                seen[text] = {"elements": None, "error": str(e)}
        kind = pa.struct([("elements", pa.map_(pa.string(), pa.float64())), ("error", pa.string())])
        return pa.array([seen[x] for x in column.to_pylist()], kind)

    return run(formula)


def element_rows(df: DataFrame, key: str, formula: str) -> DataFrame:
    """(key, element, n, weight): one row per element of each valid formula, with its atomic weight."""
    weights = refdata.table(df.sparkSession, refdata.atomic_weights(), "element string, weight double")
    parsed = df.select(key, composition(F.col(formula))["elements"].alias("elements"))
    return parsed.select(key, F.explode("elements").alias("element", "n")).join(F.broadcast(weights), "element")


def molar_masses(df: DataFrame, key: str, formula: str) -> DataFrame:
    """key, total_atoms, element_count, molar_mass (four decimals)."""
    rows = element_rows(df, key, formula)
    return rows.groupBy(key).agg(
        F.sum("n").alias("total_atoms"), F.count(F.lit(1)).alias("element_count"), F.round(F.sum(F.col("n") * F.col("weight")), 4).alias("molar_mass")
    )


def mass_fractions(df: DataFrame, key: str, formula: str) -> DataFrame:
    """key, element, n, mass_fraction (six decimals), is_stoichiometric (whether all counts of the formula are whole); none for invalid formulas.

    ``key`` stands for one formula; a formula's elements are few, so a group is small.
    """
    whole = Window.partitionBy(key)
    mass = F.col("n") * F.col("weight")
    return element_rows(df, key, formula).select(
        key, "element", "n", F.round(mass / F.sum(mass).over(whole), 6).alias("mass_fraction"), F.min(F.col("n") == F.floor("n")).over(whole).alias("is_stoichiometric")
    )
