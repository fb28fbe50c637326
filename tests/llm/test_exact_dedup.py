"""Exact copies against hashing of whole normalised texts."""

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from heatline.llm import exact_dedup

SCHEMA = "doc_id long, text string, h long, keep_id string, chunk int"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def expected(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[lowered(t)].append(d)
    return sorted((d, max(groups[lowered(t)]), len(groups[lowered(t)]), d == max(groups[lowered(t)]), hashlib.sha256(lowered(t).encode()).hexdigest()) for d, t in rows)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], SCHEMA)


LONG = "A sentence of some words, Ünïcode and all.\n" * 400
ROWS = [
    (1, None), (2, ""), (3, "Abc"), (4, "aBC"), (5, "ÄBC"), (6, "äbc"), (7, LONG), (8, LONG.upper().replace("Ü", "Ü").replace("Ï", "ï")), (9, LONG + "x"), (10, "x" + LONG),
    (11, "no boundary " * 3000), (12, "NO boundary " * 3000), (13, "w" * 100_000), (14, " "), (15, "\U0001f600.\n" * 700), (16, "\U0001f600.\n" * 700), (17, "Abc "),
]


def found(df):
    return sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect())


def test_copies_equal_brute_force(spark):
    assert found(exact_dedup.find_copies(frame(spark, ROWS))) == expected(ROWS)


def test_chunks_join_to_the_text_and_resynchronise(spark):
    df = spark.createDataFrame([(0, LONG), (1, "inserted words. " + LONG)], "i int, text string")
    rows = df.select("i", exact_dedup.chunks(F.col("text"), 64, 512).alias("c")).orderBy("i").collect()
    assert ["".join(r["c"]) for r in rows] == [LONG, "inserted words. " + LONG]
    rnd = random.Random(2)
    odd = " ".join("abcdefghijkl"[: rnd.randrange(1, 12)] + str(rnd.randrange(9)) for _ in range(6000))
    a, b = (set(r["c"]) for r in spark.createDataFrame([(odd,), ("Something new in front of it all, " + odd,)], "text string").select(exact_dedup.chunks(F.col("text"), 64, 512).alias("c")).collect())
    assert len(a) > 40 and len(a & b) > 0.8 * len(a)


def test_colliding_fingerprints_are_told_apart(spark):
    weak = lambda c: F.pmod(F.xxhash64(c), F.lit(2)).cast("long")
    assert found(exact_dedup.find_copies(frame(spark, ROWS), fingerprint=weak)) == expected(ROWS)


def test_repeated_rows_and_empty_table(spark):
    rows = [(5, "same"), (5, "same"), (2, "same"), (3, "other")]
    assert found(exact_dedup.find_copies(frame(spark, rows))) == expected(rows)
    assert found(exact_dedup.find_copies(frame(spark, []))) == []


def test_drop_copies_keeps_all_columns(spark):
    kept = exact_dedup.drop_copies(frame(spark, ROWS))
    assert kept.columns == ["doc_id", "text", "h", "keep_id", "chunk"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [r[0] for r in expected(ROWS) if r[3]]


def test_drop_copies_goes_by_id_and_text(spark):
    rows = [(5, "aaa"), (5, "bbb"), (9, "BBB"), (None, "aaa"), (None, "alone"), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(((r["doc_id"], r["text"]) for r in exact_dedup.drop_copies(df).collect()), key=str)
    assert left == sorted([(5, "aaa"), (9, "BBB"), (None, "alone"), (None, None), (None, "")], key=str)
