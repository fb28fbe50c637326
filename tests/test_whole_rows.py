"""Operators that go row by row leave no row out."""

from heatline import catalog
from heatline.sources import html

SF = "/root/testdata/sf0.001"


def test_numeric_answers_cover_every_line_item(spark):
    items = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    got = catalog.queries()["numeric_answers"](spark, SF)
    assert sorted(got.select("l_orderkey", "l_linenumber").collect()) == sorted(items.collect())


def test_coefficients_after_a_thousand_rows_are_read(spark):
    head = "<tr><th>Temperature (K)</th><td>298. to 1000.</td></tr>"
    rows = "<tr><td>note</td><td>0</td></tr>" * 1200 + "".join(f"<tr><th>{x}</th><td>{i}.5</td></tr>" for i, x in enumerate(html.LABELS))
    page = spark.createDataFrame([(1, f"<table>{head}{rows}</table>")], "page_id long, html string")
    assert [(r["t_max"], r["A"], r["H"]) for r in html.shomate_rows(page).collect()] == [(1000.0, 0.5, 7.5)]
