"""Joins against reference tables of fixed size.

The reference side is folded to one row per equality key with its alternatives in
an ordered array, so a broadcast hash join and an array filter replace the range
join and the ranking over the large side: the large side is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import refdata


def shomate_table(spark: SparkSession, priority: int = 0) -> DataFrame:
    """species, t_min, t_max, p struct(a..h), priority, id."""
    rows = [(i, s, lo, hi, *c) for i, s, lo, hi, *c in refdata.shomate()]
    df = refdata.table(spark, rows, "id int, species string, t_min double, t_max double, " + ", ".join(f"{x} double" for x in "abcdefgh"))
    return df.select("id", "species", "t_min", "t_max", F.struct(*"abcdefgh").alias("p"), F.lit(priority).alias("priority"))


def first_in_range(requests: DataFrame, ranges: DataFrame, *, on: list[str], value: str, low: str, high: str, order: list[str], payload: list[str], how: str = "left") -> DataFrame:
    """Each request with the payload of its first range that holds ``value`` (closed), by ``order``.

    ``ranges`` is a reference table of fixed size.
    """
    entry = F.struct(*order, F.col(low).alias("_low"), F.col(high).alias("_high"), *payload)
    folded = ranges.groupBy(*on).agg(F.array_sort(F.collect_list(entry)).alias("_ranges"))
    joined = requests.join(F.broadcast(folded), on, "left")
    hits = F.filter("_ranges", lambda r: F.col(value).between(r["_low"], r["_high"]))
    out = joined.withColumn("_hit", F.get(hits, 0)).drop("_ranges")
    if how == "inner":
        out = out.filter("_hit IS NOT NULL")
    return out.select("*", *[F.col("_hit")[c].alias(c) for c in payload]).drop("_hit")


def in_order(tiers: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """The first non-null value of several named tiers, and which tier it came from."""
    value = F.coalesce(*[c for _, c in tiers])
    source = F.lit(None).cast("string")
    for name, c in reversed(tiers):
        source = F.when(c.isNotNull(), name).otherwise(source)
    return value, source


def unit_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    units = refdata.table(spark, refdata.units(), "unit_id int, name string, symbol string, dimension string, category string, factor double, offset double, least double")
    return units, refdata.table(spark, refdata.unit_keys(), "key string, tier int, unit_id int")


def resolve_units(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Units by exact name, then symbol or alias, then either in lower case: adds {prefix}_name, _dimension, _category, _factor, _offset, _least."""
    units, keys = unit_tables(df.sparkSession)
    exact = keys.filter("tier < 2").groupBy("key").agg(F.min_by("unit_id", "tier").alias("unit_id"))
    folded = keys.filter("tier = 2").select("key", "unit_id")
    fields = ("name", "dimension", "category", "factor", "offset", "least")
    for table, tier, key in ((exact, "e", F.trim(F.col(column))), (folded, "f", F.lower(F.trim(F.col(column))))):
        side = table.join(F.broadcast(units), "unit_id").select(F.col("key").alias(f"_{tier}_key"), F.struct(*fields).alias(f"_{tier}"))
        df = df.join(F.broadcast(side), key == F.col(f"_{tier}_key"), "left").drop(f"_{tier}_key")
    found = F.coalesce("_e", "_f")
    return df.select("*", *[found[x].alias(f"{prefix}_{x}") for x in fields]).drop("_e", "_f")


def convert_units(df: DataFrame, value: str, source: str, target: str, *, strict: bool = True) -> DataFrame:
    """``df`` with converted, factor, zero_point, category, convert_error and below_least.

    Without ``strict`` a mismatch of dimensions still converts and only sets the error.
    """
    both = resolve_units(resolve_units(df, source, "_s"), target, "_t")
    known = F.col("_s_name").isNotNull() & F.col("_t_name").isNotNull()
    same = F.col("_s_dimension") == F.col("_t_dimension")
    error = F.when(~known, "INVALID_INPUT").when(~same, "UNIT_MISMATCH")
    si = F.col(value) * F.col("_s_factor") + F.col("_s_offset")
    raw = (si - F.col("_t_offset")) / F.col("_t_factor")
    snapped = F.when(F.abs(raw - F.rint(raw)) < 1e-12, F.rint(raw)).otherwise(raw)
    valid = known & same if strict else known
    return both.select(
        *df.columns,
        F.when(valid, snapped).alias("converted"),
        F.when(valid, F.col("_s_factor") / F.col("_t_factor")).alias("factor"),
        F.when(valid, (F.col("_s_offset") - F.col("_t_offset")) / F.col("_t_factor")).alias("zero_point"),
        F.when(known, F.col("_s_category")).alias("category"),
        error.alias("convert_error"),
        F.coalesce(F.col(value) < F.col("_s_least"), F.lit(False)).alias("below_least"),
    )
