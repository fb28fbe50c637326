"""Usage records of model calls, merged over rounds: maps whose values are numbers, texts, lists or objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _opened(df: DataFrame, columns: list[str], doc: str) -> DataFrame:
    """(columns, name, value): the fields of the documents that are objects; others have none."""
    rows = df.filter(F.startswith(F.schema_of_variant(doc), F.lit("OBJECT"))).select(*columns, F.col(doc).alias("_doc"))
    return rows.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_doc").outer())).toDF(*columns, "_doc", "_pos", "name", "value").drop("_doc", "_pos")


def merged_fields(df: DataFrame, key: str, order: list[str], doc: str) -> DataFrame:
    """(key, name, total, first): the numbers of a field added up, or else the first other value by ``order``.

    A boolean counts as 0 or 1.  A field that holds numbers in some rounds and other values in
    others is the sum of its numbers, whichever came first.  Whole numbers add up
    exactly (``total`` is then decimal text of a whole number); as soon as one of them has a fraction, all are added as
    doubles.  Of other values (null of JSON too), equal places in the order go to the least JSON text.

    One grouped pass with partial sums: a key may hold any number of rounds.
    """
    # The type is a column of its own, so that it is found once for a value.
    fields = _opened(df, [key, *order], doc).withColumn("_type", F.schema_of_variant("value"))
    value, type_ = F.col("value"), F.col("_type")
    truth = F.try_variant_get(value, "$", "boolean").cast("int")
    whole = F.when(type_ == "BOOLEAN", truth.cast("decimal(38,0)")).when(type_ == "BIGINT", F.try_variant_get(value, "$", "bigint").cast("decimal(38,0)"))
    numeric = type_.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(type_, F.lit("DECIMAL"))
    number = F.when(type_ == "BOOLEAN", truth.cast("double")).when(numeric, F.try_variant_get(value, "$", "double"))
    place = F.when(number.isNull(), F.struct(*[F.col(c) for c in order], F.to_json(value)))
    sums = fields.groupBy(key, "name").agg(
        F.count(number).alias("_numbers"), F.count(whole).alias("_whole"), F.sum(whole).alias("_exact"), F.sum(number).alias("_double"), F.min_by(value, place).alias("_first")
    )
    total = F.when(F.col("_whole") == F.col("_numbers"), F.col("_exact").cast("string")).otherwise(F.col("_double").cast("string"))
    counted = F.col("_numbers") > 0
    return sums.select(key, "name", F.when(counted, total).alias("total"), F.when(~counted, F.col("_first")).alias("first"))


def merged(df: DataFrame, key: str, order: list[str], doc: str) -> DataFrame:
    """(key, usage): one document for each key of ``df``, its fields merged; null where no round has a field."""
    fields = merged_fields(df, key, order, doc)
    value: Column = F.coalesce(F.try_parse_json("total"), "first")
    made = fields.groupBy(key).agg(F.to_variant_object(F.map_from_entries(F.collect_list(F.struct("name", value.alias("value"))))).alias("usage"))
    return df.select(F.col(key).alias("_key")).distinct().join(made, F.col("_key").eqNullSafe(F.col(key)), "left").select(F.col("_key").alias(key), "usage")
