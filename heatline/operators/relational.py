"""Filters, pages, upserts, duplicates and set checks as DataFrame functions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# ---- predicates ----


def all_of(predicates: Iterable[Column | None]) -> Column:
    """The conjunction of those that are given; TRUE for none, so the filter vanishes from the plan."""
    out = F.lit(True)
    for p in predicates:
        out = out if p is None else out & p
    return out


def contains_text(column: Column, text: str | None) -> Column | None:
    """Case-insensitive substring; % and _ stand for themselves.  No text, no predicate."""
    if not text:
        return None
    safe = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return column.ilike(f"%{safe}%")


def any_contains(columns: Iterable[Column], text: str | None) -> Column | None:
    out = None
    for c in columns:
        one = contains_text(c, text)
        out = one if out is None else out | one if one is not None else out
    return out


def null_tolerant_range(column: Column, low: float | None, high: float | None) -> Column | None:
    out = [p | column.isNull() for p in ((column >= low) if low is not None else None, (column <= high) if high is not None else None) if p is not None]
    return all_of(out) if out else None


# ---- pages ----


def page(df: DataFrame, order: list[Column | str], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1); ``order`` should be total."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_totals(df: DataFrame, size: int) -> DataFrame:
    """total and total_pages under the page's own predicate."""
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn("total_pages", F.ceil(F.col("total") / size))


def listed(df: DataFrame, columns: list[str], order: list[str], **equal: object) -> DataFrame:
    """Columns of the rows in order; a condition that is None or an empty text doesn't count."""
    given = (F.col(c) == v for c, v in equal.items() if v is not None and v != "")
    return df.filter(all_of(given)).select(*columns).orderBy(*order)


def reshaped(df: DataFrame, names: dict[str, str], zero: tuple[str, ...] = ()) -> DataFrame:
    """Columns under the names that records have outside; of those in ``zero`` null becomes 0.0.  Columns that aren't there are null."""
    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    return df.select(*[(F.coalesce(have(old).cast("double"), F.lit(0.0)) if old in zero else have(old)).alias(new) for old, new in names.items()])


# ---- writes, as plans ----


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key by ``order``: one grouped maximum of a struct, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    top = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_top"))
    return top.select(*keys, *[F.col("_top")[c].alias(c) for c in [*order, *rest]]).select(*df.columns)


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insert or replace: of all rows of a key, batch rows win over target rows, later ones over earlier."""
    rows = target.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    return latest(rows, keys, ["_new", *order]).drop("_new")


def insert_absent(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of the batch whose key the target lacks join it; the first of a key by ``order`` counts."""
    first = batch.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in batch.columns if c not in keys and c not in order])).alias("_top"))
    fresh = first.select(*keys, *[F.col("_top")[c].alias(c) for c in batch.columns if c not in keys]).select(*batch.columns)
    return target.unionByName(fresh.join(target.select(*keys).distinct(), keys, "left_anti"))


def partial_update(target: DataFrame, batch: DataFrame, keys: list[str], updated: list[str]) -> DataFrame:
    """Full outer join by key: listed columns take the batch's value where it has one, others keep the target's."""
    t, b = target.alias("t"), batch.alias("b")
    both = t.join(b, [F.col(f"t.{k}") == F.col(f"b.{k}") for k in keys], "full_outer")
    first = lambda a, c: F.coalesce(F.col(f"{a[0]}.{c}"), F.col(f"{a[1]}.{c}")).alias(c)
    return both.select(*[first("bt" if c in updated else "tb", c) for c in target.columns])


def duplicates(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Every row of a key but its first by ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n > 1").drop("_n")


# ---- sets ----


def uncovered(required: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return required.join(seen.select(*keys).distinct(), keys, "left_anti")


def nested_sets(df: DataFrame, group: list[str], order: str, members: str) -> DataFrame:
    """Whether each set strictly contains the one before it in its group."""
    w = Window.partitionBy(*group).orderBy(order)
    before = F.lag(members).over(w)
    holds = (F.size(F.array_except(before, F.col(members))) == 0) & (F.size(members) > F.size(before))
    return df.withColumn("strictly_nested", F.when(before.isNull(), F.lit(None).cast("boolean")).otherwise(holds))


def form_parameters(values: Column, numeric: Column) -> Column:
    """map<string,variant> of what a form was filled with: empty and null fields are dropped, fields in ``numeric`` read as numbers.

    A number is what a text starts with ("12 mm" is 12); a numeric field without any holds null.
    """
    filled = F.map_filter(values, lambda _, v: F.coalesce(v, F.lit("")) != "")
    number = lambda v: F.regexp_extract(v, "^\\s*([+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?)", 1).try_cast("double")
    read = lambda k, v: F.when(F.array_contains(numeric, k), F.coalesce(number(v).cast("variant"), F.parse_json(F.lit("null")))).otherwise(v.cast("variant"))
    return F.transform_values(filled, read)


def eligible(cases: DataFrame, tool: str, *known: DataFrame) -> DataFrame:
    """Cases whose tool stands in every one of the tables ``known``; repeats there don't matter."""
    for table in known:
        cases = cases.join(table.select(tool), tool, "left_semi")
    return cases
