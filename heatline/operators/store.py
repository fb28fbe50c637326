"""Traces as append-only Parquet: executions, traces and runs with last-writer-wins reads.

Writes append a batch, never rewrite; a read keeps, for every key, the first values
of fields fixed at creation and the last values of the others.  A store over two
places writes to both and reads the batches of both together, so neither a failed
write nor a place that is gone leaves stale rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .relational import reshaped

FIXED = {"execution": ("input_json", "boundary_check", "started_at"), "trace": ("user_query", "mode", "created_at"), "run": ("mode", "created_at")}
#: The columns of stored executions, and what they are called in records.
RECORD = {
    "execution_id": "execution_id", "trace_id": "trace_id", "model_code": "model_code", "model_version": "model_version", "input_json": "input", "actual_data_records": "actual_data_records",
    "boundary_check": "boundary_check", "output_json": "output", "status": "status", "error_code": "error_code", "error_message": "error", "runtime_ms": "runtime_ms",
    "user_or_agent": "user_or_agent", "started_at": "started_at", "completed_at": "completed_at",
}
KEYS = {"execution": "execution_id", "trace": "trace_id", "run": "experiment_id"}


class TraceStore:
    """One folder with a table for each kind of record."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def save(self, kind: str, rows: DataFrame, batch: int) -> None:
        """Append rows under a batch number; later batches win."""
        rows.withColumn("_batch", F.lit(batch)).write.mode("append").parquet(f"{self.path}/{kind}")

    def batches(self, kind: str) -> DataFrame:
        """All that was ever saved, with its batch number."""
        return self.spark.read.option("mergeSchema", True).parquet(f"{self.path}/{kind}")

    def all(self, kind: str) -> DataFrame:
        """The present state of every record."""
        return self.present(kind, self.batches(kind))

    @staticmethod
    def present(kind: str, rows: DataFrame) -> DataFrame:
        key, fixed = KEYS[kind], FIXED[kind]
        others = [c for c in rows.columns if c not in (key, "_batch")]
        # Nulls take no part, so a batch that leaves a field out doesn't wipe it.
        at = lambda c: F.when(F.col(c).isNotNull(), F.col("_batch"))
        return rows.groupBy(key).agg(*[(F.min_by if c in fixed else F.max_by)(c, at(c)).alias(c) for c in others])

    def get(self, kind: str, key: str) -> DataFrame:
        return self.all(kind).filter(F.col(KEYS[kind]) == key)

    def records(self) -> DataFrame:
        """Executions as records: outside names, a missing time of running as 0.0."""
        return reshaped(self.all("execution"), RECORD, zero=("runtime_ms",))

    def experiments(self) -> DataFrame:
        """Runs joined with their traces."""
        traces = self.all("trace")
        extra = [c for c in traces.columns if c not in ("mode", "created_at")]
        return self.all("run").join(traces.select(*extra), "trace_id")


class ResilientStore:
    """Writes to both stores and reads the batches of both; the last error of the first is kept."""

    def __init__(self, primary: TraceStore, fallback: TraceStore) -> None:
        self.primary, self.fallback, self.last_error = primary, fallback, None

    def save(self, kind: str, rows: DataFrame, batch: int) -> None:
        self.fallback.save(kind, rows, batch)
        try:
            self.primary.save(kind, rows, batch)
        except Exception as e:  # the fallback holds the rows; the error is kept for the caller
            self.last_error = str(e)

    def all(self, kind: str) -> DataFrame:
        rows = self.fallback.batches(kind)
        try:
            rows = rows.unionByName(self.primary.batches(kind), allowMissingColumns=True)
        except AnalysisException as e:  # nothing was written there, or it is gone
            self.last_error = str(e)
        return TraceStore.present(kind, rows)
