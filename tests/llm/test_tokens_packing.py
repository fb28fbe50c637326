"""Token counts and packing against encoding each whole text with the library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from heatline.llm import packing, queries, tokens

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "\n\n", "a", "Hello<|endoftext|> there <|endoftext|>", "a\x1cb c\x1f d", "  x  y\n\n  z \t q ", "ΣΑΣ ẞ İi̇ é é", "don't we'll 12345 x_y", "x" * 20_000, "word " * 30_000,
    "a　b c\u0085d e   ", "\U0001f600 ok <|startoftext|>",
]


def random_texts(n, seed=1):
    rnd, letters = random.Random(seed), list("ab \n\t'sé́ \x1c1<|>_Σ  ")
    return ["".join(rnd.choice(letters) for _ in range(rnd.randrange(80))) for _ in range(n)]


def encoded(texts, path):
    """The ids of every text, after a check that lengths alone come out the same."""
    column = pa.array(texts, pa.string())
    counts, ids = tokens.encode_column(column, path, True)
    assert tokens.encode_column(column, path, False)[0].tolist() == counts.tolist()
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def library(texts, path):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_lengths_and_ids_equal_the_library(path):
    texts = TEXTS + random_texts(1500)
    assert encoded(texts, path) == library(texts, path)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_every_letter_before_every_mark_equals_the_library(path):
    letters = [c for c in map(chr, range(0x110000)) if c.isalpha()]
    marks = ".,;:!?%&*#$"
    texts = ["".join(f" ab{c}{m} {c}{m}x\n{c}{marks[(i + 1) % 11]}" for c in letters[k : k + 20]) for k in range(0, len(letters), 20) for i, m in enumerate(marks[k % 5 :: 5])]
    latin = [c for c in letters if ord(c) < 0x250]
    texts += [f"ab{c}{m} {c}{m}x\n{c.upper()}{m} {c}" for c in latin for m in marks]
    assert encoded(texts, path) == library(texts, path)


def test_small_groups_and_a_small_memory_change_nothing(monkeypatch):
    texts = ["some words and  more\nwords " * 50, *random_texts(300, 2)]
    for name, value in (("KNOWN_PIECES", 4), ("KNOWN_LENGTH", 5), ("ENCODE_BYTES", 20), ("GROUP_BYTES", 40), ("JOINED", 3), ("_coders", {})):
        monkeypatch.setattr(tokens, name, value)
    assert encoded(texts, BYTES) == library(texts, BYTES) and encoded(texts, WORDS) == library(texts, WORDS)


def test_a_vocabulary_of_another_kind_gets_whole_texts(tmp_path):
    other = Tokenizer.from_file(BYTES)
    other.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "merged_with_previous"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    path = str(tmp_path / "other.json")
    other.save(path)
    texts = TEXTS + random_texts(200, 3)
    assert tokens.coder(path, True).kind is None and encoded(texts, path) == library(texts, path)


def test_count_columns(spark):
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, N_Tokens long, tokens string")
    rows = tokens.with_token_counts(df, BYTES, limit=100).orderBy("doc_id").collect()
    whole = Tokenizer.from_file(BYTES)
    for r, t in zip(rows, TEXTS, strict=True):
        n = len(whole.encode(t or "", add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"], r["N_Tokens_in"]) == (len((t or "").encode()), n, n > 100, 5)
    assert tokens.with_token_counts(df.limit(0), BYTES).count() == 0


def check_pieces(rows, docs, capacity=4096):
    """Every id in exactly one piece, sequences gapless and not over-full, padding only off powers of two."""
    sequences, seen = {}, {}
    for r in rows:
        ids = docs[r["doc_id"]]
        part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert r["ids_crc32"] == zlib.crc32(part) and r["doc_tokens"] == len(ids) and r["length"] > 0
        seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert seen.keys() == docs.keys()
    for d, parts in seen.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(docs[d])
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / max(1, sum(map(len, docs.values())))


def packed(spark, texts, **options):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, start long, ids string").repartition(3)
    rows = packing.pack(df, WORDS, **options).select("*", F.crc32("ids").alias("ids_crc32")).collect()
    whole = Tokenizer.from_file(WORDS)
    return rows, {i: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}


@pytest.mark.parametrize("options", [{}, {"block_tokens": 9000}, {"capacity": 64}])
def test_packing_holds_every_id_once(spark, options):
    rnd = random.Random(5)
    texts = TEXTS + [" ".join(rnd.choice(["der", "tion", "ing"]) for _ in range(rnd.choice([3, 50, 700, 5000]))) for _ in range(120)]
    rows, docs = packed(spark, texts, **options)
    assert check_pieces(rows, docs, options.get("capacity", 4096)) == 0


def test_packing_an_empty_table_and_one_window(spark):
    assert packed(spark, [])[0] == []
    rows, docs = packed(spark, [None])
    assert [(r["length"], r["offset"]) for r in rows] == [(1, 0)] and check_pieces(rows, docs) == 0


def test_closest_multiset_equals_brute_force():
    rnd = random.Random(7)
    for _ in range(300):
        counts = {rnd.randrange(1, 40): rnd.randrange(1, 5) for _ in range(rnd.randrange(1, 6))}
        capacity = rnd.randrange(1, 90)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * m for s in sums for m in range(n + 1)}
        taken = packing.closest_multiset(counts, capacity)
        assert all(0 < n <= counts[k] for k, n in taken.items())
        assert sum(k * n for k, n in taken.items()) == max(s for s in sums if s <= capacity)


def test_contract_query_on_the_small_tables(spark):
    rows = queries.op2_packing(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    whole = Tokenizer.from_file(WORDS)
    want = {r["doc_id"]: [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in docs}
    assert check_pieces(rows, want) == 0
