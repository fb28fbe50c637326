"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A normalised text is cut where its own content says so (before a word of seven
characters that one of three follows, about once in a hundred words, and past a
least length), so shared passages give shared chunks wherever they stand.  Each chunk is fingerprinted inside its row,
and a document becomes the ordered list of its chunks' fingerprints: its recipe.
Chunk texts move once, deduplicated before the shuffle, to verify that no two
different chunks share a fingerprint.  Texts that hold a shared one are cut again
and listed by their chunks' SHA-256, so two forms of list never mix.  Verified recipes are then equal exactly
if the texts are, so grouping compares short lists and long documents stay put.

Null counts as empty; all empty texts are one group; a very long text is a long recipe of
one row.  Rows that share a doc_id
are one row each, and all of them are kept if that doc_id is the group's largest.
Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Least and largest chunk, in UTF-16 units.
MIN_CHUNK, MAX_CHUNK = 128, 4096
#: What follows a cut.
BOUNDARY = r"\s(?=\S{7}\s\S{3}\s)"


def normalised(text: Column) -> Column:
    """A-Z lower-cased, other characters as they are; null as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The chunks of ``text`` in order; together they are the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most - 1}}}?{BOUNDARY}|.{{1,{most}}}"), F.lit(0))


def recipes(
    df: DataFrame, scratch: tables.Scratch, *, doc_id: str = "doc_id", text: str = "text", fingerprint: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """doc_id, text_sha256 and, of every row, recipe (its chunks' fingerprints) or told_apart (longer identifiers, where a fingerprint is shared)."""
    source = df.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("norm")).withColumn("text_sha256", F.sha2("norm", 256))
    plain = scratch.stage(source.select("doc_id", "text_sha256", F.transform(chunks(F.col("norm")), lambda c: fingerprint(c)).alias("recipe")), "recipes")
    apart = source.select(F.explode(chunks(F.col("norm"))).alias("chunk")).select(fingerprint(F.col("chunk")).alias("fp"), "chunk").distinct()
    shared = scratch.stage(apart.groupBy("fp").count().filter("count > 1").select("fp"), "shared_fingerprints")
    if shared.isEmpty():
        return plain.withColumn("told_apart", F.lit(None).cast("array<string>"))
    # Only texts that hold such a chunk are cut again; a text equal to one of them is among them.
    held = plain.select("text_sha256", F.explode("recipe").alias("fp")).join(shared, "fp", "left_semi")
    texts = scratch.stage(held.select("text_sha256").distinct(), "texts_cut_again")
    again = source.join(texts, "text_sha256", "left_semi").select("doc_id", "text_sha256", F.lit(None).cast("array<bigint>").alias("recipe"), F.transform(chunks(F.col("norm")), lambda c: F.sha2(c, 256)).alias("told_apart"))
    rest = plain.join(texts, "text_sha256", "left_anti").withColumn("told_apart", F.lit(None).cast("array<string>"))
    return scratch.stage(rest.unionByName(again), "verified")


def find_copies(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    scratch = tables.Scratch(df.sparkSession, "exact_dedup")
    own = recipes(df, scratch, doc_id=doc_id, text=text, fingerprint=fingerprint).withColumn("h", F.xxhash64("recipe", "told_apart"))
    groups = own.groupBy("h", "recipe", "told_apart").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    # Written out, so that both sides of the join are dealt afresh and a group of very many copies can be split.
    groups = scratch.stage(groups.withColumnsRenamed({c: f"g_{c}" for c in ("h", "recipe", "told_apart")}), "copy_groups")
    scratch.drop("verified" if "verified" in scratch.written else "recipes", "copy_groups")
    same = (own["h"] == groups["g_h"]) & own["recipe"].eqNullSafe(groups["g_recipe"]) & own["told_apart"].eqNullSafe(groups["g_told_apart"])
    return own.join(groups, same, "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("keep_id") == F.col("doc_id"), F.col("keep_id").isNull()).alias("kept"),
        "text_sha256",
    )


def drop_copies(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay: of equal texts those with the largest doc_id.

    A row goes by its doc_id and its text, so where rows with different texts share a
    doc_id, each goes or stays by its own text.  A null doc_id is the smallest.
    """
    gone = find_copies(df, doc_id=doc_id, text=text).filter("NOT kept").select(F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_sha256")).distinct()
    gone = tables.stage(gone, "copies_gone")
    same = df[doc_id].eqNullSafe(gone["_gone"]) & (F.sha2(normalised(df[text]), 256) == gone["_sha256"])
    return df.join(gone, same, "left_anti")
