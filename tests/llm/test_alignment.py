"""Alignment of two vocabularies against a plain version over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from heatline.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def coders():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def spell(coders, text):
    """(ids, ends) of both sides over the whole text; None where bytes differ."""
    a, b = coders
    want = (" " + (text or "")).encode()
    if not text:
        return None
    own = {c: i for i, c in alignment._byte_of().items()}
    own = {i: c for c, i in own.items()}
    out = []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(own[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    for ids, parts in ((ids_a, bytes_a), (ids_b, bytes_b)):
        if b"".join(parts) != want:
            return None
        ends, at = [], 0
        for p in parts:
            at += len(p)
            ends.append(at)
        out.append((ids, ends))
    return out


def plain(coders, docs):
    links, groups = [], []
    count = Counter()
    for _, text in docs:
        found = spell(coders, text)
        if not found:
            links.append([])
            groups.append(([], [], []))
            continue
        (ia, ea), (ib, eb) = found
        own = [(a, b) for i, a in enumerate(ia) for j, b in enumerate(ib) if max(ea[i - 1] if i else 0, eb[j - 1] if j else 0) < min(ea[i], eb[j])] if len(ia) < 2000 else linear(ia, ea, ib, eb)
        links.append(own)
        count.update(own)
        both, shown, i, j = sorted(set(ea) & set(eb)), [], 0, 0
        for edge in both:
            x, y = ea.index(edge, i) + 1, eb.index(edge, j) + 1
            shown.append(",".join(map(str, ia[i:x])) + "|" + ",".join(map(str, ib[j:y])))
            i, j = x, y
        groups.append((ia, ib, shown))
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    rows = []
    for (doc_id, _), own, (ia, ib, shown) in zip(docs, links, groups):
        digest = hashlib.sha256(";".join(shown).encode()).hexdigest() if shown else ""
        rows.append((doc_id, len(ia), len(ib), len(shown), len(own), sum(count[p] == most[p[1]] for p in own), sum(count[p] for p in own), digest))
    return sorted(rows, key=str)


def linear(ia, ea, ib, eb):
    out, i, j = [], 0, 0
    while i < len(ia):
        out.append((ia[i], ib[j]))
        x, y = ea[i], eb[j]
        i += x <= y
        j += y <= x
    return out


def texts():
    draw = random.Random(5)
    parts = ["the", " quick", "  ", "\n", "\t ", "naïve", "漢字かな", "🙂", "　", "\u0085 x", "<s>", "</s>", "<|endoftext|>", "<0x41>", "ﬁ", "é́", "12345", "'s", "!?", "\u0000", "\u001c ", "internationalisation"]
    out = [None, "", " ", "  ", "a", " a ", "a▁b", "▁", "ok then ▁ no", "x y " * 6000]
    return out + ["".join(draw.choice(parts) + draw.choice(("", " ")) for _ in range(draw.randrange(1, 60))) for _ in range(300)]


def test_query(spark, tmp_path, coders):
    docs = [(k, t) for k, t in enumerate(texts())] + [(4, "repeated id"), (4, "repeated id"), (None, "null id")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op12_alignment(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(coders, docs)


def test_hot_ids_are_dealt_over_tasks(spark, coders, monkeypatch):
    docs = [(k, f"the same words {k % 7}") for k in range(400)]
    df = spark.createDataFrame([(*d, "kept", 1) for d in docs], "doc_id long, text string, n_a string, extra int").repartition(6)
    aligned = alignment.alignments(df, A, B)
    assert {"n_a_in", "n_a", "extra", "groups"} <= set(aligned.columns)
    scored = alignment.link_scores(aligned, sides=3, group_blocks=1)
    got = [(r["doc_id"], r["n_links"], r["n_best"], r["count_sum"], r["n_a_in"], r["extra"]) for r in scored.collect()]
    assert sorted(got) == sorted((r[0], *r[4:7], "kept", 1) for r in plain(coders, docs))
    assert scored.select("groups").distinct().count() == 7


def test_contributions_are_given_away_when_many(spark, coders, monkeypatch):
    sums = alignment._Sums()
    sums.add(1, *map(lambda x: __import__("numpy").array(x), ([3, 3, 300], [1, 0, 1], [5, 6, 7])))
    rows = [r for b in sums.rows() for r in b.to_pylist()]
    assert rows == [{"block": 1, "part": 0, "at": [3], "n_best": [1], "count_sum": [11]}, {"block": 1, "part": 1, "at": [300], "n_best": [1], "count_sum": [7]}]
    assert not list(sums.rows())


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.link_scores(alignment.alignments(none, A, B)).collect() == []
