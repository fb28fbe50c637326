"""Reading inputs and staging intermediate tables in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Batch = TypeVar("Batch")
_own_dirs: dict[str, str] = {}
_folders: list[str] = []


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a temporary one where none is set and all runs on this machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = spark.sparkContext.applicationId
        base = _own_dirs[own] = _own_dirs.get(own) or tempfile.mkdtemp(prefix="heatline-")
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    _folders.append(f"{shared_dir(spark)}/heatline-{uuid.uuid4().hex}")
    return f"{_folders[-1]}/{name}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def folders() -> int:
    """How many folders of staged tables this process has opened."""
    return len(_folders)


def clean(spark: SparkSession, since: int, upto: int | None = None) -> None:
    """Deletes the staged tables of the folders opened from the ``since``-th on, up to the ``upto``-th: what was read from them must have been written elsewhere."""
    for path in _folders[since:upto]:
        remove(spark, path)


class Scratch:
    """Tables that one call of an operator writes in a folder of its own."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.written = spark, shared_path(spark, name), []

    def stage(self, df: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
        """Write ``df`` as Parquet and read it back: cuts the lineage and survives lost executors.

        ``row_group`` bounds the bytes of a row group, and so of a batch that is read, where rows hold long arrays.
        """
        self.written.append(name)
        path = f"{self.path}/{len(self.written)}-{name}"
        (df.write.option("parquet.block.size", row_group) if row_group else df.write).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self, name: str) -> None:
        """Deletes one table."""
        remove(self.spark, f"{self.path}/{self.written.index(name) + 1}-{name}")

    def drop(self, *kept: str) -> None:
        """Deletes all tables but those that the result still reads."""
        for k, name in enumerate(self.written, 1):
            if name not in kept:
                remove(self.spark, f"{self.path}/{k}-{name}")


def small_batches(df: DataFrame, rows: int = 512) -> DataFrame:
    """``df``, after limiting the rows of Arrow batches in its session: texts are long, and memory goes by the batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= rows:
        df.sparkSession.conf.set(key, str(rows))
    return df


def gathered(batches: Iterable[Batch], limit: int) -> Iterator[list[Batch]]:
    """Arrow batches or columns in lists of about ``limit`` bytes each; a larger one comes alone."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def aside(df: DataFrame, names: Iterable[str]) -> dict[str, str]:
    """Under which name each column of ``df`` is kept beside results called ``names``: its own, or with ``_in`` behind it."""
    taken, out = {n.lower() for n in names} | {c.lower() for c in df.columns}, {}
    given = {n.lower() for n in names}
    for c in df.columns:
        out[c] = c
        if c.lower() in given:
            while out[c].lower() in taken:
                out[c] += "_in"
            taken.add(out[c].lower())
    return out


def set_aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns under their names of ``aside``, and those names."""
    kept = aside(df, names)
    return df.select(*[df[f"`{c}`"].alias(a) for c, a in kept.items()]), kept


def given(found: DataFrame, df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The columns of ``df`` out of ``found``, which an operator with results called ``names`` has made of it."""
    return found.select(*[F.col(f"`{a}`").alias(c) for c, a in aside(df, names).items()])


def fresh(df: DataFrame, prefix: str) -> str:
    """A prefix that no column of ``df`` begins with."""
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
