"""Every query with SQL against DuckDB on the smallest tables, and independence from the order of rows."""

import math
import os

import duckdb
import pytest

from heatline import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, (int, float)):
        return "nan" if math.isnan(v) else round(float(v), 8) + 0.0
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=str)
    if name not in catalog.oracle_sql():
        assert got
        return
    relation = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in relation.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=str)


def test_row_order_does_not_matter(spark, tmp_path):
    spark.read.parquet(f"{SF}/orders.parquet").orderBy("o_totalprice").repartition(5).write.parquet(str(tmp_path / "orders.parquet"))
    for name in ("paired_contrasts", "overall_effect", "bootstrap_with_given_draws", "cluster_bootstrap"):
        plan = catalog.queries()[name]
        rows = lambda d: sorted((tuple(plain(x) for x in r) for r in plan(spark, d).collect()), key=str)  # noqa: B023, E731
        assert rows(SF) == rows(str(tmp_path))
