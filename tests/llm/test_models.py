"""Quality and language models: held-out accuracy, edge cases, and the mixture against plain EM."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from heatline.llm import language, quality, queries

SF = "/root/testdata/sf0.01"


def crc(i):
    return zlib.crc32(str(i).encode())


def test_quality_on_held_out_documents(spark):
    rows = {r["doc_id"]: r for r in queries.op3_quality(spark, SF).collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r["held_out"] == (crc(d) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for d, r in rows.items())
    held = [d for d in labels if d in rows and rows[d]["held_out"]]
    assert np.mean([rows[d]["predicted"] == labels[d] for d in held]) >= 0.97


def test_quality_edge_cases(spark):
    schema = "doc_id long, text string, quality_label string, _label int"
    texts = [None, "", " \n", "x" * 200_000, "word " * 40_000, "ok ok ok", "ok ok ok"]
    docs = spark.createDataFrame([(i, t, "q", 3) for i, t in enumerate(texts)], schema)
    none = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    assert {r["quality_score"] for r in quality.with_quality(docs, none).collect()} == {1.0}
    some = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    rows = sorted(quality.with_quality(docs, some).collect(), key=lambda r: r["doc_id"])
    assert len(rows) == 7 and rows[0]["quality_score"] == rows[1]["quality_score"] == rows[2]["quality_score"] and rows[5]["quality_score"] == rows[6]["quality_score"]
    assert quality.with_quality(docs.limit(0), some).count() == 0


def test_grams_equal_a_plain_walk():
    texts = ["One two TWO two!! three", "", None, "%%% a1b ééé ééé", "solo"]
    buckets, bounds = quality.gram_buckets(pa.array(texts))
    for k, t in enumerate(texts):
        alone, _ = quality.gram_buckets(pa.array([t]))
        assert buckets[bounds[k] : bounds[k + 1]].tolist() == alone.tolist()
    n = [len(quality.gram_buckets(pa.array([t]))[0]) for t in texts]
    assert n == [11, 0, 0, 11, 1]
    again, _ = quality.gram_buckets(pa.array(["two two", "xx xx"]))
    assert again[2] == again[5]  # a word after itself is one feature, whatever the word


def test_ftrl_learns_a_separable_rule():
    rnd, model = random.Random(0), quality.Ftrl(4)
    for _ in range(400):
        y = rnd.randrange(2)
        model.learn(np.array([y, 16]), np.array([1.0, 1.0]), np.array([0, 0]), np.array([float(y)]))
    w = model.weights()
    assert w[1] + w[16] > 1 > -1 > w[0] + w[16]


def test_language_on_held_out_documents(spark):
    rows = {r["doc_id"]: r for r in queries.op4_language(spark, SF).collect()}
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()}
    assert rows.keys() == docs.keys()
    assert all(r["held_out"] == (crc(d) % 3 == 1) and 0 <= r["score"] <= 1 for d, r in rows.items())
    held = [d for d, r in rows.items() if r["held_out"] and docs[d]["lang"]]
    assert np.mean([rows[d]["lang_pred"] == docs[d]["lang"] for d in held]) >= 0.97


def model_of(samples):
    batch = pa.RecordBatch.from_pydict({"t": [t for _, t in samples], "l": [x for x, _ in samples]})
    return language.log_table(pa.Table.from_batches(language._count(iter([batch]))))


SAMPLES = [("en", "the thing was that and with the others from there " * 20), ("de", "und der mit ungen heit keit schlich verein auf das " * 20), ("fr", "les eaux tion ment que dans vous étaient leur elle " * 20)]


def test_mixtures_and_their_sets():
    names, table = model_of(SAMPLES)
    texts = [
        "the other thing was with that " * 30, "der und das mit schlich " * 30, ("the thing was with that " * 10 + "und der mit das auf heit ver keit " * 30),
        "", None, "12 34 !!", "the", "x" * 50_000, ("les eaux que dans " + "vous elle ment leur ") * 20_000,
    ]
    best, part = language.infer(pa.array(texts, pa.string()), table)
    got = [names[i] if i >= 0 else None for i in best]
    assert got[:3] == ["en", "de", "de"] and got[3:6] == [None] * 3 and got[6] == "en" and got[8] == "fr"
    assert part[0] > 0.95 and 0.55 < part[2] < 0.9 and ((0 <= part) & (part <= 1)).all()


def test_mixture_equals_plain_em():
    rng = np.random.default_rng(3)
    likely, bounds = rng.random((50, 3)) + 1e-3, np.array([0, 20, 20, 50])
    share, ll = language._mixture(likely, np.repeat([0, 2], [20, 30]), bounds, np.full((3, 3), 1 / 3), 15)
    for row, (a, b) in ((0, (0, 20)), (2, (20, 50))):
        p = np.full(3, 1 / 3)
        for _ in range(15):
            r = likely[a:b] * p
            p = (r / r.sum(1, keepdims=True)).mean(0)
        assert np.allclose(share[row], p) and np.isclose(ll[row], np.log(likely[a:b] @ p).sum())


def test_language_edge_cases(spark):
    schema = "doc_id long, text string, lang string, _guess int"
    train = spark.createDataFrame([(i, t, x, 1) for i, (x, t) in enumerate(SAMPLES)] + [(9, None, "en", 1), (10, "zz", None, 1)], schema)
    docs = spark.createDataFrame([(0, None, None, 1), (1, "", None, 1), (2, "123 !?", None, 1), (3, "the thing with that", None, 1), (3, "the thing with that", None, 1), (4, "中文 文字", None, 1)], schema)
    rows = sorted(language.with_language(docs.select("doc_id", "text"), train).collect(), key=lambda r: r["doc_id"])
    assert [r["lang_pred"] for r in rows[:5]] == ["und", "und", "und", "en", "en"] and rows[5]["lang_pred"] in ("de", "en", "fr")
    assert {r["lang_pred"] for r in language.with_language(docs.select("doc_id", "text"), train.limit(0)).collect()} == {"und"}
    assert language.with_language(docs.limit(0), train).count() == 0


def test_quality_scores_equal_plain_ftrl(spark):
    """Every score of a small table against FTRL written out term by term."""
    rnd = random.Random(12)
    texts = [" ".join(rnd.choice(["ore", "slag", "melt", "flux"] if i % 2 else ["win", "cash", "melt", "now"]) for _ in range(rnd.randrange(1, 9))) for i in range(60)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    got = {r["doc_id"]: r["quality_score"] for r in quality.with_quality(docs, labels).collect()}

    def shares(text):
        found, _ = quality.gram_buckets(pa.array([text or ""]))
        return {b: n * quality.SCALE / max(1, len(found)) for b, n in Counter(found.tolist()).items()} | {"bias": 1.0}

    z, n = Counter(), Counter()

    def weight(f):
        if abs(z[f]) <= quality.L1:
            return 0.0
        return -(z[f] - math.copysign(quality.L1, z[f])) / ((quality.BETA + math.sqrt(n[f])) / quality.ALPHA + quality.L2)

    order = labels.filter(quality.learnable(F.col("doc_id"))).orderBy(F.xxhash64("doc_id")).collect()
    for _ in range(quality.EPOCHS):
        for i in range(0, len(order), quality.BATCH):
            some = [(shares(texts[r["doc_id"]]), r["quality"]) for r in order[i : i + quality.BATCH]]
            old, gradient = {f: weight(f) for x, _ in some for f in x}, Counter()
            for x, label in some:
                p = 1 / (1 + math.exp(-sum(v * old[f] for f, v in x.items())))
                for f, v in x.items():
                    gradient[f] += (p - label) * v
            for f, g in gradient.items():
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / quality.ALPHA * old[f]
                n[f] += g * g
    for d, text in enumerate(texts):
        assert math.isclose(got[d], 1 / (1 + math.exp(-sum(v * weight(f) for f, v in shares(text).items()))), abs_tol=1e-4)


def test_columns_named_as_results_keep_their_values(spark):
    docs = spark.createDataFrame([(1, "ore slag", "en", 5, "x"), (2, None, None, 6, "y")], "doc_id long, text string, lang string, Quality_Score int, lang_pred string")
    scored = quality.with_quality(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert {(r["doc_id"], r["Quality_Score_in"]) for r in scored.collect()} == {(1, 5), (2, 6)}
    named = language.with_language(docs, docs)
    assert {(r["doc_id"], r["lang_pred_in"], r["lang_pred"]) for r in named.collect()} == {(1, "x", "en"), (2, "y", "und")}


def test_too_many_labels_raise_an_error_and_none_is_left_out(spark):
    docs = spark.createDataFrame([(i, "abc def", f"l{i % 7 % 5}") for i in range(35)], "doc_id long, text string, lang string")
    assert language.fit(docs, max_langs=5)[0] == ["l0", "l1", "l2", "l3", "l4"]
    with pytest.raises(ValueError, match="more than 4 languages"):
        language.fit(docs, max_langs=4)
