"""Coefficient tables in HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = "ABCDEFGH"


def _cells(row: Column) -> Column:
    """The texts of a table row's cells."""
    raw = F.regexp_extract_all(row, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))
    return F.transform(raw, lambda c: F.trim(F.regexp_replace(c, r"<[^>]*>", "")))


def _number(text: Column) -> Column:
    """A number as such pages print it; anything else is 0."""
    text = F.replace(F.replace(text, F.lit("×10"), F.lit("e")), F.lit("−"), F.lit("-"))
    return F.coalesce(F.regexp_replace(text, "[ ,]", "").try_cast("double"), F.lit(0.0))


def species_key(formula: Column, phase: Column) -> Column:
    """``formula(phase)``, or the formula alone where no phase is told."""
    return F.when(F.coalesce(phase, F.lit("")) == "", formula).otherwise(F.concat(formula, F.lit("("), phase, F.lit(")")))


def shomate_rows(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, table_no, range_no, t_min, t_max, A..H): one row per temperature column of each complete table.

    A table counts if its first row speaks of temperature and rows A to H are there;
    columns whose head isn't a range "lo to hi" are skipped.
    """
    tables = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<table[^>]*>(.*?)</table>"), F.lit(1))
    found = pages.select(key, F.posexplode(tables).alias("table_no", "_table")).filter(F.contains(F.col("_table"), F.lit("Temperature")))
    rows = F.transform(F.regexp_extract_all("_table", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)), _cells)
    found = found.select(key, "table_no", rows.alias("_rows")).filter(F.size("_rows") >= 3)
    head = F.get("_rows", 0)
    found = found.filter(F.exists(head, lambda c: F.contains(c, F.lit("Temperature"))))
    body = F.map_from_entries(F.filter(F.transform(F.slice("_rows", F.lit(2), F.size("_rows") - 1), lambda r: F.struct(F.get(r, 0).alias("k"), r.alias("v"))), lambda e: F.coalesce(e["k"].isin(*LABELS), F.lit(False))))
    found = found.select(key, "table_no", head.alias("_head"), body.alias("_body")).filter(F.size("_body") == len(LABELS))
    each = found.select(key, "table_no", "_body", F.posexplode("_head").alias("range_no", "_range")).filter("range_no > 0")
    bound = lambda i: F.get(F.split(F.replace("_range", F.lit(","), F.lit("")), "to"), i)
    each = each.withColumn("t_min", F.trim(bound(0)).try_cast("double")).withColumn("t_max", F.rtrim(F.trim(bound(1)), F.lit(".")).try_cast("double"))
    cell = lambda x: F.coalesce(_number(F.get(F.element_at("_body", F.lit(x)), F.col("range_no"))), F.lit(0.0)).alias(x)
    return each.filter("t_min IS NOT NULL AND t_max IS NOT NULL").select(key, "table_no", "range_no", "t_min", "t_max", *[cell(x) for x in LABELS])


def chosen_range(rows: DataFrame, key: str, limit: float = 50_000.0) -> DataFrame:
    """The first range of each table; the second instead where the first one's H is beyond ``limit``."""
    pick = F.array_sort(F.collect_list(F.struct("range_no", "t_min", "t_max", *LABELS)))
    folded = rows.groupBy(key, "table_no").agg(pick.alias("_r"))
    first, second = F.get("_r", 0), F.get("_r", 1)
    best = F.when((F.abs(first["H"]) > limit) & second.isNotNull(), second).otherwise(first)
    return folded.select(key, "table_no", best.alias("_b")).select(key, "table_no", "_b.*")
