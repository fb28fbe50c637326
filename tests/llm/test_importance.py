"""Importance resampling against a plain version, with CRCs by the library and sums in Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from heatline.llm import importance, queries

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    lowered = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = WORD.findall(lowered)
    return words, [b" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain(docs, target, percent=5, least=20):
    own, wanted = Counter(), Counter()
    for counter, texts in ((own, [t for _, t in docs]), (wanted, target)):
        for t in texts:
            counter.update(zlib.crc32(g) % 10000 for g in grams(t)[1])
    s_all, t_all = sum(own.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10000) / ((own[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    rows = []
    for doc_id, text in docs:
        words, features = grams(text)
        weight = sum(gain[zlib.crc32(g) % 10000] for g in features)
        h = int(hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(features), weight, score, None, len(words) >= least])
    eligible = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], math.inf if r[0] is None else r[0], r[1]))
    for k, r in enumerate(eligible[: percent * len(eligible) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=str)


def words(draw, n):
    kinds = ["Alpha", "beta", "naïve", "漢字" * 40, "x" * 70, "7", "it's", "--", "\u0000", "é́", "word" * 16, "word" * 17]
    return " ".join(draw.choice(kinds) + str(draw.randrange(30)) for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    draw = random.Random(3)
    texts = [None, "", " .,; ", "one", "Two WORDS", words(draw, 40_000), words(draw, 19), words(draw, 20)] + [words(draw, draw.randrange(300)) for _ in range(190)]
    return [(k, t) for k, t in enumerate(texts)] + [(5, texts[9]), (9, texts[9]), (9, texts[9]), (None, texts[10])]


def test_crc_of_ngrams():
    draw = random.Random(1)
    texts = [words(draw, n) for n in (0, 1, 2, 3, 50)] + ["y" * 5000 + " z " + "q" * 100_000, "Ab", "z"]
    row, bucket, n = importance.features(pa.array(texts))
    for k, t in enumerate(texts):
        own, features = grams(t)
        assert n[k] == len(own)
        assert sorted(bucket[row == k]) == sorted(zlib.crc32(g) % 10000 for g in features)


def test_query(spark, tmp_path, docs):
    target = [docs[8][1], docs[20][1], None, "alpha beta"]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = queries.op11_importance(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {t for _, t in found.dtypes} == {"bigint"}
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(docs, target)


def test_ranks_over_many_ranges(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    target = spark.createDataFrame([("alpha",)], "text string")
    found = importance.resample(df, target, percent=50, least_words=1)
    assert sorted((tuple(r) for r in found.drop("n_words").collect()), key=str) == plain(docs, ["alpha"], 50, 1)


def test_blocks_hold_the_matrix(spark, docs):
    blocks = importance.count_blocks(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), block_entries=500).collect()
    assert len(blocks) > 10
    seen = []
    for b in blocks:
        assert len(b["starts"]) == len(b["docs"]) + 1 and b["starts"][-1] == len(b["buckets"]) == len(b["counts"])
        for doc, n, i, j in zip(b["docs"], b["features"], b["starts"], b["starts"][1:]):
            assert list(b["buckets"][i:j]) == sorted(set(b["buckets"][i:j]))
            assert sum(b["counts"][i:j]) == n
            seen.append((doc, n))
    assert sorted(seen, key=str) == sorted(((d, len(grams(t)[1])) for d, t in docs), key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none).collect() == []
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [r["rank"] for r in importance.resample(some, none).collect()] == [None]


def test_shift_tables_against_the_library():
    a, b = b"left part", b"right" * 1000
    for n in (0, 1, 63, 64, 65, 1000, 5000):
        got = importance._after_zeros(np.array([zlib.crc32(a)], np.uint32), np.array([n]))[0] ^ np.uint32(zlib.crc32(b[:n]))
        assert got == zlib.crc32(a + b[:n])
