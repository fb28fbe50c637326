"""The pipeline's stages as wired, each against brute force over what the stage before left."""

import os
import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
from test_near_dedup import brute_force
from tokenizers import Tokenizer

import corpus_pipeline
from heatline.llm import quality, tables

#: The last two are named as results of stages.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, quality_predicted int, mix_epoch string"


def documents():
    rnd = random.Random(5)
    good = ["steel", "heat", "phase", "carbon", "oxide", "melt", "flow", "mass", "rate", "slag", "alloy", "grain"]
    junk = ["click", "buy", "free", "win", "cash", "spam", "deal", "now"]
    texts = [" ".join(rnd.choice(junk if i % 3 == 0 else good) for _ in range(60)) for i in range(150)]
    texts += [texts[1], texts[1].upper(), texts[4], texts[7] + " steel", texts[8] + " heat", None, "", texts[0]]
    return [(i, t, None if i % 5 == 0 else "en", "small" if i % 10 == 1 else "large", len(t or ""), 7, None) for i, t in enumerate(texts)]


def run(spark, folder, rows, labels, monkeypatch):
    spark.createDataFrame(rows, DOCS).repartition(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    left = {}

    def stage(df, name):
        staged = tables.stage(df, name)
        left[name] = [tuple(r) for r in staged.collect()]
        return staged

    monkeypatch.setattr(corpus_pipeline, "tables", SimpleNamespace(**{n: getattr(tables, n) for n in ("read", "given", "folders", "clean")}, stage=stage))
    before = tables.folders()
    out = corpus_pipeline.run(spark, str(folder)).collect()
    assert list(left) == [name for name, _ in corpus_pipeline.STAGES]
    standing = [p for p in tables._folders[before:] if os.path.exists(p.removeprefix("file:"))]
    assert len(standing) == 1 and standing == tables._folders[-1:]  # the result alone
    return out, {name: rows for name, rows in left.items() if name != "packing"}


def test_run_and_its_stages_equal_brute_force(spark, tmp_path, monkeypatch):
    rows = documents()
    labels = [(i, int(i % 3 != 0), 0) for i in range(120)]
    out, left = run(spark, tmp_path, rows, labels, monkeypatch)

    docs = spark.createDataFrame(rows, DOCS)
    scored = quality.with_quality(docs, spark.createDataFrame([x[:2] for x in labels], "doc_id long, quality int"))
    wanted = {r["doc_id"] for r in scored.collect() if r["quality_predicted"] == 1}
    kept = [r for r in rows if r[0] in wanted]
    assert sorted(left["quality"], key=str) == sorted(kept, key=str) and 0 < len(kept) < len(rows)

    last = {}
    for r in kept:
        last[(r[1] or "").lower()] = max(r[0], last.get((r[1] or "").lower(), -1))
    unique = [r for r in kept if last[(r[1] or "").lower()] == r[0]]
    assert sorted(left["exact_dedup"], key=str) == sorted(unique, key=str) and len(unique) < len(kept)

    groups = brute_force([(r[0], r[1]) for r in unique])
    apart = [r for r in unique if groups[r[0]][1] == r[0]]
    assert sorted(left["near_dedup"], key=str) == sorted(apart, key=str) and len(apart) < len(unique)

    copies = Counter(left["mixing"])
    assert copies.keys() == set(apart) and set(copies.values()) <= {1, 2}

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r[0]: [*whole.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in apart}
    covered, sequences = defaultdict(Counter), defaultdict(list)
    for r in out:
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        covered[r["doc_id"]].update(range(r["start"], r["start"] + r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["offset"] + r["length"]))
    assert covered == {r[0]: Counter(dict.fromkeys(range(len(ids[r[0]])), n)) for r, n in copies.items()}
    for spans in sequences.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 4096 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_an_empty_table_stays_empty(spark, tmp_path, monkeypatch):
    out, left = run(spark, tmp_path, [], [(1, 1, 0)], monkeypatch)
    assert out == [] and set(map(len, left.values())) == {0}
