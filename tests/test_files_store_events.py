"""File sources and sinks, the trace store and event streams, against results written out by hand."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from heatline.operators import registry
from heatline.operators.store import RECORD, ResilientStore, TraceStore
from heatline.sources import files
from heatline.streaming import events


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_csv_is_read_as_text_and_empty_cells_take_defaults(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿key,Name\n1,x\n2,\n ,lost\n", encoding="utf-8")
    df = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["key", "Name"]
    assert rows(files.keyed_rows(df, "key", {"key": "id", "Name": "name"}, {"name": "none"}), "id", "name") == [("1", "x"), ("2", "none")]


def test_json_lines_skip_blank_lines_and_null_unreadable_ones(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n  \nbroken\n{"a": 3}\n')
    assert rows(files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int"), "a") == [(1,), (3,), (None,)]
    (tmp_path / "b.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert rows(files.read_json(spark, str(tmp_path / "b.json")), "a") == [(1,), (2,)]


def test_csv_parts_share_the_union_of_columns(spark, tmp_path):
    a, b = spark.createDataFrame([(1, [1, 2])], "x int, y array<int>"), spark.createDataFrame([(None, "t")], "x int, z string")
    files.write_csv([a, b], str(tmp_path / "out"))
    got = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert got.columns == ["x", "y", "z"] and rows(got.na.fill(""), "x", "y", "z") == [("", "", "t"), ("1", "[1,2]", "")]
    files.write_csv([a.limit(0)], str(tmp_path / "none"))
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "none")), "status") == [("no_rows",)]
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_jsonl(a, str(tmp_path / "out"), "r1")


def test_manifest_differences_and_seal(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_text(name)
    found = files.manifest(spark, str(tmp_path))
    digest = hashlib.sha256(b"a").hexdigest()
    assert ("a", 1, digest) in rows(found, "filename", "bytes", "sha256")
    stated = spark.createDataFrame([("a", digest), ("b", "other"), ("c", "x")], "filename string, sha256 string")
    assert rows(files.manifest_differences(stated, found), "filename", "problem") == [("b", "changed"), ("c", "missing")]
    want = hashlib.sha256("\n".join(["before", f"a:{digest}"]).encode()).hexdigest()
    assert files.seal(stated.filter("filename = 'a'"), "before") == want


def test_later_batches_win_but_for_fixed_fields(spark, tmp_path):
    first, second = TraceStore(spark, str(tmp_path / "one")), TraceStore(spark, str(tmp_path / "two"))
    both = ResilientStore(first, second)
    save = lambda store, batch, mode, note: store.save("run", spark.createDataFrame([("e", mode, "t0", note)], "experiment_id string, mode string, created_at string, note string"), batch)
    save(both, 1, "direct", "old")
    save(second, 2, "forced", "new")  # as if the first place had failed
    save(both, 3, "auto", None)
    assert rows(both.all("run"), "experiment_id", "mode", "note") == [("e", "direct", "new")]
    assert rows(first.get("run", "e"), "note") == [("old",)]
    gone = ResilientStore(TraceStore(spark, str(tmp_path / "gone")), second)
    assert rows(gone.all("run"), "note") == [("new",)] and gone.last_error


def test_streams_give_the_batch_answers(spark, tmp_path):
    data = [(1, "2026-01-01 00:10:00", 1, "a", 1.5, "{}"), (2, "2026-01-01 00:50:00", 1, "a", 2.0, "{}"), (2, "2026-01-01 00:50:00", 1, "a", 2.0, "{}"), (3, "2026-01-01 01:05:00", 2, "b", 4.0, "{}")]
    df = spark.createDataFrame(data, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.first_seen(events.read_folder(spark, str(tmp_path / "in")), late="2 hours")
    query = stream.writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120) and rows(spark.table("seen"), "event_id") == [(1,), (2,), (3,)]
    assert rows(events.windowed_rates(df), "event_type", "n", "total") == [("a", 3, 5.5), ("b", 1, 4.0)]
    # 00:10 lies 40 minutes before 00:50, beyond the gap of half an hour.
    assert rows(events.sessions(df), "user_id", "n") == [(1, 1), (1, 2), (2, 1)]


def test_json_documents_are_indented_and_end_with_a_line_break(spark, tmp_path):
    report = spark.createDataFrame([(1, None, [1, 2], {"a": "x"})], "n int, none string, list array<int>, map map<string,string>")
    files.write_json(report, str(tmp_path / "one"))
    written = "".join(p.read_text() for p in sorted((tmp_path / "one").glob("part-*")))
    assert json.loads(written) == {"n": 1, "none": None, "list": [1, 2], "map": {"a": "x"}}
    assert written.endswith("}\n") and '\n  "n"' in written
    assert rows(files.read_json(spark, str(tmp_path / "one"), "n int, list array<int>"), "n", "list") == [(1, [1, 2])]
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_json(report, str(tmp_path / "one"))


def test_stored_executions_as_records(spark, tmp_path):
    store = TraceStore(spark, str(tmp_path / "store"))
    store.save("execution", spark.createDataFrame([("e1", "t1", "{}", None), ("e2", "t1", None, 2.5)], "execution_id string, trace_id string, input_json string, runtime_ms double").withColumns({"boundary_check": F.lit("ok"), "started_at": F.lit("now")}), 1)
    found = store.records()
    assert found.columns == list(RECORD.values())
    assert rows(found, "execution_id", "input", "runtime_ms", "error") == [("e1", "{}", 0.0, None), ("e2", None, 2.5, None)]


def test_reviews_of_cards(spark):
    cards = spark.createDataFrame([("A", ["x", "y"]), ("B", []), ("C", None)], "model_code string, required array<string>")
    cases = spark.createDataFrame([("A",), ("A",), ("Z",), (None,)], "model_code string")
    findings = spark.createDataFrame([("A", "fine"), ("B", "later"), ("B", "first"), ("Z", "no card")], "model_code string, finding string")
    got = registry.review_rows(cards, cases, findings)
    assert rows(got, "model_code", "golden_case_count", "required_field_count", "generated_invalid_input_case_count", "finding", "problem") == [
        ("A", 2, 2, 10, "fine", None), ("B", 0, 0, 0, "first", "more than one finding"), ("C", 0, 0, 0, None, "no finding"),
    ]
    assert all(r[c] is None for r in got.collect() for c in registry.REVIEW_COLUMNS)
