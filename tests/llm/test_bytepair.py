"""Byte-level BPE: ids of split texts against the library over whole texts, and raw bytes back."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from heatline.llm import bytepair, queries

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = [None, "", " ", "\n\n", "it's <|endoftext|> 12'll", "  a  b ", "naïve 漢字　かな\u0085x   y", "é́ ﷺ 🙂🙂", "x" * 3000, "a b " * 40_000, " " * 70_000, "a" + " \n" * 60_000 + "b's 1"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_parts_keep_the_ids_of_the_whole(library):
    draw = random.Random(7)
    alphabet = ["a", "B", "'s", "'", " ", "  ", "\n", "\t", "　", "\u0085", "\u001c", "1", "é", "漢", "!", "·", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(draw.choice(alphabet) * draw.choice((1, 1, 1, 9)) for _ in range(draw.randrange(40)))
        for long in (1, 4, 10):
            assert "".join(p for p, _ in bytepair.parts(text, long)) == text
            assert bytepair.encode(text, library, long) == library.encode_ordinary(text)


def test_run_of_white_space_that_the_matcher_cannot_hold(library):
    text = "a" + " " * 1_500_000 + "b"
    ids = bytepair.encode(text, library)
    assert library.decode_bytes(ids).decode() == text
    assert ids == library.encode_ordinary("a") + library._encode_single_piece(" " * 1_499_999) + library.encode_ordinary(" b")


def test_columns_and_query(spark, tmp_path, library):
    rows = [(k, t, k) for k, t in enumerate(TEXTS)] + [(3, TEXTS[4], None), (None, "null id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bpe_ids int")
    found = bytepair.with_ids(docs, PATH, PATTERN)
    assert found.columns == ["doc_id", "text", "bpe_ids_in", "bpe_ids"]
    for r in found.withColumn("raw", bytepair.decoded("bpe_ids", PATH, PATTERN)).collect():
        assert list(r["bpe_ids"]) == library.encode_ordinary(r["text"] or "")
        assert bytes(r["raw"]).decode() == (r["text"] or "")
    docs.drop("bpe_ids").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in queries.op13_byte_bpe(spark, str(tmp_path)).collect()), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = {t: library.encode_ordinary(t or "") for t in [*TEXTS, "null id"]}
    assert got == sorted(((k, len(ids[t]), sha(",".join(map(str, ids[t])).encode()), sha((t or "").encode())) for k, t, _ in rows), key=str)


def test_parts_of_a_character_decode_to_raw_bytes(spark, library):
    ids = library.encode_ordinary("🙂")
    assert len(ids) > 1
    cut = spark.createDataFrame([(ids[:1],), (None,), ([],)], "ids array<int>").select(bytepair.decoded("ids", PATH, PATTERN).alias("raw")).collect()
    assert [bytes(r["raw"]) for r in cut] == [library.decode_bytes(ids[:1]), b"", b""]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bytepair.with_ids(none, PATH, PATTERN).collect() == []
