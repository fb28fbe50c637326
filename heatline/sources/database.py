"""Relational databases: partitioned reads with push-down, and upserts by a staging table and one merge.

Rows travel between the database and the tasks by Spark's JDBC source.  The driver sends only
statements: it never holds rows.
"""

from __future__ import annotations

import os
import re
import shlex
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import latest

#: Environment variables of the usual client library, and the options they set.
SETTINGS = {"PGHOST": "host", "PGPORT": "port", "PGDATABASE": "dbname", "PGUSER": "user", "PGPASSWORD": "password", "PGSSLMODE": "sslmode", "PGAPPNAME": "application_name"}
DSN_VARIABLES = ("DATABASE_URL", "POSTGRES_DSN")
_PROPERTIES = {"user": "user", "password": "password", "sslmode": "sslmode", "application_name": "ApplicationName", "connect_timeout": "connectTimeout"}
#: Databases in which Spark stages texts as CLOB, which has no equality: how they become texts again (32,672 is the most a VARCHAR holds there).
_TEXTS = {"jdbc:derby:": "CAST({0} AS VARCHAR(32672))"}
_NAME = re.compile(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)?")


def _settings(dsn: str) -> dict[str, str]:
    """What a DSN says, as a URL or as ``key=value`` pairs."""
    if "://" not in dsn:
        return dict(pair.split("=", 1) for pair in shlex.split(dsn))
    parts = urlsplit(dsn)
    found = {"host": parts.hostname, "port": str(parts.port or ""), "dbname": parts.path.strip("/"), "user": parts.username, "password": parts.password}
    found |= dict(pair.split("=", 1) for pair in parts.query.split("&") if "=" in pair)
    return {k: unquote(v) for k, v in found.items() if v}


def options(dsn: str | None = None, *, connect_timeout: int = 3, environment: dict[str, str] | None = None) -> dict[str, str]:
    """Options of a JDBC source: a JDBC URL as it is; else a DSN, given or in the environment, over the PG* variables."""
    if dsn and dsn.startswith("jdbc:"):
        return {"url": dsn}
    env = os.environ if environment is None else environment
    dsn = dsn or next((env[v] for v in DSN_VARIABLES if env.get(v)), None)
    told = {"connect_timeout": str(connect_timeout)} | (_settings(dsn) if dsn else {name: env[v] for v, name in SETTINGS.items() if env.get(v)})
    place = f"{told.get('host', 'localhost')}:{told.get('port', '5432')}/{told.get('dbname', 'postgres')}"
    return {"url": f"jdbc:postgresql://{place}", "driver": "org.postgresql.Driver"} | {_PROPERTIES[k]: v for k, v in told.items() if k in _PROPERTIES}


def read(spark: SparkSession, table: str, source: dict[str, str], *, column: str | None = None, partitions: int = 1) -> DataFrame:
    """A table; filters and column lists go to the database.

    With ``column`` (a number, date or timestamp) the rows are read by ``partitions`` tasks, each a
    range of equal width between the least and largest value that the database holds; nulls
    go with the first.  An empty table, or one of nulls, is read by one task.
    """
    reader = spark.read.format("jdbc").options(**source)
    if not column or partitions < 2:
        return reader.option("dbtable", _checked(table)).load()
    ends = reader.option("query", f"SELECT MIN({_checked(column)}) AS lo, MAX({column}) AS hi FROM {_checked(table)}").load().first()
    reader = spark.read.format("jdbc").options(**source).option("dbtable", table)
    if ends[0] is None:
        return reader.load()
    # The upper bound only sets the width of a range: no row beyond it is lost.
    return reader.options(partitionColumn=column, lowerBound=str(ends[0]), upperBound=str(ends[1]), numPartitions=partitions).load()


def _checked(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise ValueError(f"not a name of a table or column: {name!r}")
    return name


@contextmanager
def connection(spark: SparkSession, source: dict[str, str]) -> Iterator[Any]:
    """A connection for statements, one transaction: committed at the end, rolled back on an error."""
    jvm = spark.sparkContext._jvm
    login = jvm.java.util.Properties()
    for k, v in source.items():
        if k not in ("url", "driver"):
            login.setProperty(k, v)
    con = jvm.java.sql.DriverManager.getConnection(source["url"], login)
    try:
        con.setAutoCommit(False)
        yield con
        con.commit()
    except BaseException:
        con.rollback()
        raise
    finally:
        con.close()


def execute(spark: SparkSession, source: dict[str, str], *statements: str) -> list[int]:
    """Statements of one transaction; the number of rows that each changed."""
    with connection(spark, source) as con:
        statement = con.createStatement()
        return [statement.executeUpdate(s) for s in statements]


def exists(spark: SparkSession, source: dict[str, str], name: str, *, schema: bool = False) -> bool:
    """Whether the database has a table (``name`` or ``schema.name``), or a schema, of this name; case doesn't count."""
    owner, _, own = _checked(name).rpartition(".")
    with connection(spark, source) as con:
        about = con.getMetaData()
        rows = about.getSchemas() if schema else about.getTables(None, None, None, None)
        while rows.next():
            found = rows.getString("TABLE_SCHEM") or ""
            if schema and found.lower() == name.lower():
                return True
            if not schema and rows.getString("TABLE_NAME").lower() == own.lower() and owner.lower() in ("", found.lower()):
                return True
    return False


def upsert(
    df: DataFrame, table: str, keys: list[str], order: list[str], source: dict[str, str], *, updated: list[str] | None = None, partitions: int = 8
) -> int:
    """Insert or update rows of ``table`` by key; the number of rows merged.

    Of the rows of a key, the last by ``order`` counts.  Keys that are there take the columns ``updated`` (all
    others than the keys by default; an empty list leaves them as they are), other keys are inserted.

    Tasks write to a staging table of this run, which the target never sees; a task that is run again
    can leave its rows there twice, so one statement takes distinct rows and the next merges them,
    in one transaction.  A run that fails changes nothing, one that is repeated changes nothing more.
    Null keys are an error of the database.
    """
    spark, (stage, whole) = df.sparkSession, (f"{_checked(table)}_{kind}_{uuid.uuid4().hex[:12]}" for kind in ("s", "w"))
    target = {f.name.lower(): f for f in read(spark, table, source).schema.fields}
    columns = [c for c in df.columns if c.lower() in target]
    unknown = [c for c in df.columns if c not in columns and c not in order]
    if unknown:
        raise ValueError(f"columns that {table} lacks: {unknown}")
    names = {c: f'"{target[c.lower()].name}"' for c in columns}
    listed, same = ", ".join(names.values()), " AND ".join(f"t.{names[k]} = s.{names[k]}" for k in keys)
    changed = [c for c in columns if c not in keys] if updated is None else updated
    update = "WHEN MATCHED THEN UPDATE SET " + ", ".join(f"{names[c]} = s.{names[c]}" for c in changed) if changed else ""
    rows = latest(df, keys, order).select(*[F.col(c).cast(target[c.lower()].dataType).alias(target[c.lower()].name) for c in columns])
    text = next((form for url, form in _TEXTS.items() if source["url"].startswith(url)), "{0}")
    staged = ", ".join((text if rows.schema[i].dataType == T.StringType() else "{0}").format(n) for i, n in enumerate(names.values()))
    execute(spark, source, f"CREATE TABLE {whole} AS SELECT {listed} FROM {table} WITH NO DATA")
    try:
        rows.write.format("jdbc").options(**source).options(dbtable=stage, numPartitions=partitions).mode("errorifexists").save()
        return execute(
            spark, source, f"INSERT INTO {whole} SELECT DISTINCT {staged} FROM {stage}",
            f"MERGE INTO {table} t USING {whole} s ON {same} {update} WHEN NOT MATCHED THEN INSERT ({listed}) VALUES ({', '.join(f's.{n}' for n in names.values())})",
        )[1]
    finally:
        # Spark makes the staging table when it begins to write, so it may not be there yet.
        execute(spark, source, *[f"DROP TABLE {t}" for t in (stage, whole) if exists(spark, source, t)])
