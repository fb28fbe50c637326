"""Reads, upserts and existence over the embedded database that comes with Spark."""

import uuid

import pytest
from pyspark.sql import functions as F

from heatline.operators.relational import listed
from heatline.sources import database, tables


@pytest.fixture
def source(spark):
    out = {"url": f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"}
    database.execute(spark, out, "CREATE TABLE registry (dataset_id VARCHAR(20) NOT NULL PRIMARY KEY, name VARCHAR(40), grade VARCHAR(2), n INT, v DOUBLE)")
    return out


def stored(spark, source, table="registry"):
    return sorted(tuple(r) for r in database.read(spark, table, source).collect())


def batch(spark, rows):
    return spark.createDataFrame(rows, "seq int, dataset_id string, name string, grade string, n int, v double")


FIRST = [(1, "a", "old", "A", 1, 0.5), (2, "a", "new", "B", 2, 1.5), (1, "b", "b", None, None, None), (3, "c'\"", "quote ' \"", "A", 3, 2.5)]


def test_the_last_row_of_a_key_is_written_and_a_second_run_changes_nothing(spark, source):
    expected = [("a", "new", "B", 2, 1.5), ("b", "b", None, None, None), ("c'\"", "quote ' \"", "A", 3, 2.5)]
    for _ in range(2):
        assert database.upsert(batch(spark, FIRST), "registry", ["dataset_id"], ["seq"], source) == 3
        assert stored(spark, source) == expected


def test_only_the_columns_named_are_updated(spark, source):
    database.upsert(batch(spark, FIRST[:1]), "registry", ["dataset_id"], ["seq"], source)
    later = batch(spark, [(1, "a", "renamed", "Z", 9, 9.0), (1, "d", "d", "D", 4, 4.0)])
    database.upsert(later, "registry", ["dataset_id"], ["seq"], source, updated=["name"])
    assert stored(spark, source) == [("a", "renamed", "A", 1, 0.5), ("d", "d", "D", 4, 4.0)]
    database.upsert(batch(spark, [(1, "a", "x", "X", 0, 0.0), (1, "e", "e", "E", 5, 5.0)]), "registry", ["dataset_id"], ["seq"], source, updated=[])
    assert stored(spark, source) == [("a", "renamed", "A", 1, 0.5), ("d", "d", "D", 4, 4.0), ("e", "e", "E", 5, 5.0)]


def test_a_task_that_wrote_twice_merges_once(spark, source, monkeypatch):
    once = database.latest
    monkeypatch.setattr(database, "latest", lambda *a: (lambda r: r.unionAll(r))(once(*a)))
    assert database.upsert(batch(spark, FIRST), "registry", ["dataset_id"], ["seq"], source) == 3
    assert len(stored(spark, source)) == 3


def test_a_run_that_fails_changes_nothing_and_leaves_no_staging_table(spark, source):
    database.upsert(batch(spark, FIRST), "registry", ["dataset_id"], ["seq"], source)
    before = stored(spark, source)
    with pytest.raises(Exception):
        database.upsert(batch(spark, [(1, "f", "f", "F", 1, 1.0), (1, None, "none", "N", 1, 1.0)]), "registry", ["dataset_id"], ["seq"], source)
    with pytest.raises(Exception):
        database.upsert(batch(spark, [(1, "g", "x" * 100, "F", 1, 1.0)]), "registry", ["dataset_id"], ["seq"], source)
    assert stored(spark, source) == before
    with database.connection(spark, source) as con:
        found = con.createStatement().executeQuery("SELECT COUNT(*) FROM sys.systables WHERE tabletype = 'T'")
        found.next()
        assert found.getInt(1) == 1


def test_an_empty_batch_and_unknown_columns(spark, source):
    assert database.upsert(batch(spark, []), "registry", ["dataset_id"], ["seq"], source) == 0
    with pytest.raises(ValueError, match="other"):
        database.upsert(batch(spark, FIRST).withColumn("other", F.lit(1)), "registry", ["dataset_id"], ["seq"], source)


def test_ranges_are_read_by_many_tasks_with_filters_and_columns_pushed_down(spark, source):
    rows = spark.range(500).select(F.lit(1).alias("seq"), F.col("id").cast("string").alias("dataset_id"), F.lit("n").alias("name"), F.lit("A").alias("grade"), (F.col("id") - 50).cast("int").alias("n"), F.lit(1.0).alias("v"))
    database.upsert(rows.unionByName(batch(spark, [(1, "none", "n", "B", None, 1.0)])), "registry", ["dataset_id"], ["seq"], source)
    df = database.read(spark, "registry", source, column="n", partitions=4)
    assert df.rdd.getNumPartitions() == 4
    assert df.count() == 501 and df.filter("n IS NULL").count() == 1
    assert {r[0] for r in df.filter("n >= 440").select("n").collect()} == set(range(440, 450))
    plan = df.filter("grade = 'A' AND n > 440").select("DATASET_ID")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(GRADE,A)" in plan and "GreaterThan(N,440)" in plan and "ReadSchema: struct<DATASET_ID:string>" in plan


def test_an_empty_table_has_no_bounds(spark, source):
    assert database.read(spark, "registry", source, column="n", partitions=4).count() == 0


def test_existence_of_tables_and_schemas(spark, source):
    assert database.exists(spark, source, "Registry") and database.exists(spark, source, "app.registry") and database.exists(spark, source, "sys", schema=True)
    assert not database.exists(spark, source, "registries") and not database.exists(spark, source, "sys.registry") and not database.exists(spark, source, "nosuch", schema=True)
    spark.range(1).createOrReplaceTempView("existing_view")
    assert tables.exists(spark, "existing_view") and not tables.exists(spark, "no_such_view") and tables.exists(spark, "default", database=True)


def test_names_are_checked(spark, source):
    for name in ("registry; DROP TABLE registry", "a.b.c", "", 'x"'):
        with pytest.raises(ValueError, match="name"):
            database.read(spark, name, source)


def test_options_come_from_a_dsn_or_the_environment():
    env = {"PGHOST": "db1", "PGPORT": "6000", "PGDATABASE": "d", "PGUSER": "u", "PGPASSWORD": "p", "PGSSLMODE": "require"}
    assert database.options(environment=env) == {"url": "jdbc:postgresql://db1:6000/d", "driver": "org.postgresql.Driver", "user": "u", "password": "p", "sslmode": "require", "connectTimeout": "3"}
    assert database.options(environment={}) == {"url": "jdbc:postgresql://localhost:5432/postgres", "driver": "org.postgresql.Driver", "connectTimeout": "3"}
    url = "postgresql://u:p%40x@h:7000/base?sslmode=prefer"
    assert database.options(environment=env | {"DATABASE_URL": url}) == {"url": "jdbc:postgresql://h:7000/base", "driver": "org.postgresql.Driver", "user": "u", "password": "p@x", "sslmode": "prefer", "connectTimeout": "3"}
    assert database.options("host=h dbname='my base' user=u", environment=env)["url"] == "jdbc:postgresql://h:5432/my base"
    assert database.options("jdbc:derby:memory:x") == {"url": "jdbc:derby:memory:x"}


def test_a_listing_of_sources_reads_its_columns_in_order(spark, source):
    database.upsert(batch(spark, FIRST), "registry", ["dataset_id"], ["seq"], source)
    rows = listed(database.read(spark, "registry", source).toDF("dataset_id", "name", "grade", "n", "v"), ["dataset_id", "name"], ["dataset_id"], grade="", name=None)
    assert [r["dataset_id"] for r in rows.collect()] == ["a", "b", "c'\""]
    graded = listed(database.read(spark, "registry", source), ["DATASET_ID"], ["DATASET_ID"], GRADE="A")
    assert [r[0] for r in graded.collect()] == ["c'\""]
    assert "EqualTo(GRADE,A)" in graded._jdf.queryExecution().executedPlan().toString()
