"""Chains of records, each of which names the one before it, and ids from what records hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .documents import _checkpointed


def record_hash(record: Column) -> Column:
    """SHA-256 of a JSON text in canonical form: fields sorted, no blanks; null for what isn't JSON."""
    return F.sha2(F.to_json(F.try_parse_json(record)), 256)


def record_id(record: Column, prefix: str) -> Column:
    """``prefix`` and the first 20 hex digits of the record's hash: the same record has the same id."""
    return F.concat(F.lit(prefix), F.upper(F.substring(record_hash(record), 1, 20)))


def chain_positions(df: DataFrame, node: str, previous: str) -> DataFrame:
    """(node, root, position, state) of every record: how many records stand before it, and where its chain begins.

    Found by pointer jumping: every round doubles how far a record looks back, so the
    longest chain takes as many rounds as its length has binary digits.  ``state`` is ok, ``broken`` (the
    record before isn't there, here or further back), ``fork`` (more than one record names the same one before
    it), ``cycle`` (no beginning is reached; position and root are null) or ``repeated`` (the
    id stands more than once; it has one row).
    """
    own = df.filter(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(previous).alias("before"), F.count(F.lit(1)).alias("rows"))
    successors = own.filter("before IS NOT NULL").groupBy("before").agg(F.count(F.lit(1)).alias("siblings"))
    known = own.select(F.col("node").alias("_known"))
    rows = own.join(known, own["before"] == known["_known"], "left").join(successors, "before", "left")
    state = rows.select(
        "node", "rows", F.coalesce("siblings", F.lit(0)).alias("siblings"), F.col("_known").alias("to"), F.when(F.col("_known").isNotNull(), 1).otherwise(0).cast("long").alias("position"),
        F.coalesce("_known", "node").alias("root"), (F.col("before").isNotNull() & F.col("_known").isNull()).alias("broken"),
    )
    state = _checkpointed(state)
    for _ in range(max(1, state.count()).bit_length() + 1):
        if state.filter("to IS NOT NULL").isEmpty():
            break
        far = state.select(F.col("node").alias("_n"), F.col("to").alias("_to"), F.col("position").alias("_position"), F.col("root").alias("_root"), F.col("broken").alias("_broken"))
        met = state.join(far, state["to"] == far["_n"], "left")
        state = _checkpointed(
            met.select(
                "node", "rows", "siblings", F.col("_to").alias("to"), (F.col("position") + F.coalesce("_position", F.lit(0))).alias("position"), F.coalesce("_root", "root").alias("root"),
                (F.col("broken") | F.coalesce("_broken", F.lit(False))).alias("broken"),
            )
        )
    endless = F.col("to").isNotNull()
    kind = F.when(F.col("rows") > 1, "repeated").when(endless, "cycle").when(F.col("siblings") > 1, "fork").when(F.col("broken"), "broken").otherwise("ok")
    return state.select("node", F.when(~endless, F.col("root")).alias("root"), F.when(~endless, F.col("position")).alias("position"), kind.alias("state"))
