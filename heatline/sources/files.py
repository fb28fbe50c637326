"""File sources and sinks: CSV, JSON, JSON Lines, manifests and sealed snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; a byte-order mark before the first name is dropped."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def keyed_rows(df: DataFrame, key: str, names: dict[str, str], defaults: dict[str, str] | None = None) -> DataFrame:
    """Rows with a non-empty key, columns renamed, empty values replaced by defaults."""
    kept = df.filter(F.trim(F.coalesce(F.col(key), F.lit(""))) != "")
    value = lambda old, new: F.coalesce(F.nullif(F.trim(F.col(old)), F.lit("")), F.lit((defaults or {}).get(new)))
    return kept.select(*[value(old, new).alias(new) for old, new in names.items()])


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One object a line; blank lines are skipped, unreadable ones become null rows."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def flat_text(df: DataFrame) -> DataFrame:
    """Every column as text for a flat file: nested values as JSON, null as the empty text."""
    def cell(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        nested = isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))
        return F.coalesce(F.to_json(c) if nested else c.cast("string"), F.lit("")).alias(field.name)

    return df.select(*[cell(f) for f in df.schema.fields])


def write_csv(parts: list[DataFrame], path: str) -> None:
    """Rows of all parts under the union of their columns, in the order first seen; without rows one status row."""
    rows = flat_text(parts[0])
    for p in parts[1:]:
        rows = rows.unionByName(flat_text(p), allowMissingColumns=True)
    rows = rows.na.fill("")
    if rows.isEmpty():
        rows = rows.sparkSession.createDataFrame([("no_rows",)], "status string")
    rows.write.option("header", True).option("emptyValue", "").mode("errorifexists").csv(path)


def write_jsonl(df: DataFrame, path: str, run_id: str) -> None:
    """JSON Lines with the run's id in every row; an existing path is an error."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("errorifexists").json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Every row as an indented JSON document that ends with a line break; nulls are written, an existing path is an error.

    A report of one row is one document.  The documents of more rows follow each other, as ``read_json`` reads them.
    """
    df.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """filename, bytes, sha256 of every file under ``path``; hashing is done where the files are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_differences(stated: DataFrame, found: DataFrame) -> DataFrame:
    """filename and problem (missing, unexpected, changed) where a manifest doesn't hold."""
    both = stated.alias("s").join(found.alias("f"), "filename", "full_outer")
    problem = F.when(F.col("f.sha256").isNull(), "missing").when(F.col("s.sha256").isNull(), "unexpected").when(F.col("s.sha256") != F.col("f.sha256"), "changed")
    return both.select("filename", problem.alias("problem")).filter("problem IS NOT NULL")


def seal(entries: DataFrame, previous: str | None) -> str:
    """The hash of a manifest chained to the one before; entries are few, one for each artifact."""
    rows = entries.select(F.concat_ws(":", "filename", "sha256").alias("e")).agg(F.sort_array(F.collect_list("e")).alias("e"))
    return rows.select(F.sha2(F.concat_ws("\n", F.lit(previous or ""), F.array_join("e", "\n")), 256)).collect()[0][0]
