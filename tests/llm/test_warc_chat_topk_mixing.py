"""Round trips of archives and chats, exact search against brute force, mixtures against their definition."""

import hashlib
import io
import math
import random
from collections import defaultdict

import pyarrow as pa
import pytest

from heatline.llm import chat, mixing, tables, topk, warc

# ---- archives ----

PAGES = [
    (5, "http://a/b c", "<p>one</p>"), (3, None, "<p>one</p>"), (9, "http://x\r\ny", None), (2, "u", ""), (7, "u", "é" * 70_000), (8, "u", "x\r\n\r\nWARC/1.1\r\n"), (None, "u", "unnamed"), (6, "u", "<p>one</p>"), (6, "u", "<p>one</p>"),
]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "x") for i, u, h in rows], "page_id long, url string, html string, first_id int, payload string").repartition(2)


@pytest.mark.parametrize("range_bytes", [64, 1000, 1 << 20])
def test_archives_read_back_whole_from_any_ranges(spark, range_bytes):
    manifest = warc.write(pages(spark, PAGES), tables.shared_path(spark, "warc_test"))
    read = warc.read(manifest, range_bytes=range_bytes).collect()
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = sorted((i or 0, len((h or "").encode()), warc.digest((h or "").encode()), "response" if first.get(h or "", i) == i else "revisit", None if first.get(h or "", i) == i else first[h or ""]) for i, _, h in PAGES)
    assert sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in read) == want
    by_id = {r["page_id"]: r["payload"] for r in read if r["record_type"] == "response"}
    assert all(bytes(by_id[i]) == (h or "").encode() for i, _, h in PAGES if i in by_id)


def test_small_payloads_stay_responses(spark):
    read = warc.round_trip(pages(spark, PAGES), min_bytes=11).collect()
    assert {r["record_type"] for r in read} == {"response"}
    assert warc.round_trip(pages(spark, []), min_bytes=0).count() == 0


def test_false_magic_is_not_a_record():
    real = [warc.record(i, "u", bytes([31, 139, 8]) * 50 + b"payload %d" % i, None) for i in range(3)]
    noise = b"\x1f\x8b\x08" + bytes(range(40))
    archive = real[0] + real[1] + real[2]
    sizes = [0, len(real[0]), len(real[0]) + len(real[1])]
    for start in range(0, len(archive), 37):
        got = [at for at, _ in warc.records_in(pa.BufferReader(archive), len(archive), start, start + 37)]
        assert got == [s for s in sizes if start <= s < start + 37]
    assert [at for at, _ in warc.records_in(pa.BufferReader(noise + archive), len(archive) + len(noise), 0, 10**6)] == [len(noise) + s for s in sizes]


# ---- chats ----


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, n_turns int, formatted string").repartition(3)


def test_chats_read_back_what_went_in(spark):
    rnd = random.Random(4)
    alphabet = ["\\", "#", "###", "<", "</turn>", "\n", ":", "é", "\U0001f600", " ", "### Assistant: ", "ok"]
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "a:b", None]), rnd.choice([None, "", "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(12)))])) for c in range(60) for t in range(rnd.randrange(1, 9))]
    rows += [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok"), (None, 3, "user", "no id"), (5, 0, "user", "tie"), (5, 0, "user", "tie")]
    rows += [(99, t, "assistant", "long " * 300) for t in range(60)]
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(turns(spark, rows))).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role is not None, role or "", text is not None, text or ""))
    assert got.keys() == by.keys()
    for c, own in by.items():
        own = [(r, t) for _, _, r, _, t in sorted(own)]
        learned = [t for r, t in own if r == "assistant"]
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[c]["loss_chars"] == sum(map(len, learned)) and got[c]["loss_sha256"] == hashlib.sha256("".join(learned).encode()).hexdigest()
        assert got[c]["formatted_chars"] == len(chat.marked_turns(own))
    assert chat.format_conversations(turns(spark, rows).limit(0)).count() == 0


def test_templates_that_rewrite_history_are_found():
    plain = lambda own: "".join(f"[{r}]{t}" for r, t in own)
    counted = lambda own: f"{len(own)} turns:" + plain(own)
    own = [("user", "a"), ("assistant", "b"), ("user", "c")]
    assert chat.turn_spans(own, plain) == ("[user]a[assistant]b[user]c", [(0, 7), (7, 19), (19, 26)], False)
    assert chat.turn_spans(own, counted)[2] is True


# ---- search ----


def test_search_equals_brute_force(spark):
    rnd = random.Random(6)
    rows = [(i, [rnd.choice([-1.5, -0.25, 0.0, 0.1, 0.5, 2.0]) for _ in range(6)]) for i in range(300)]
    rows += [(300, None), (350, [1.0, None]), (400, [float("nan")] * 6), (450, [float("inf")] * 6), (500, []), (550, [1.0, 2.0]), (600, [1e30] * 6)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]
    rows.append((50, rows[50][1]))
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, score string")
    own = df.select("vec_id", topk.quantised(df["embedding"]).alias("weights"))
    got = defaultdict(list)
    for r in topk.top_k(own, own.filter("vec_id % 50 = 0"), 5, group_rows=64).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    as_float = lambda v: [struct_float(x) for x in v]
    sound = [(i, [clipped(math.floor(256 * x)) for x in as_float(v)]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for q, qv in sound:
        if q % 50 == 0:
            scores = sorted((-clipped(sum(a * b for a, b in zip(qv, v, strict=False))), i) for i, v in sound if i != q)
            want = [(i, -s) for s, i in scores[:5]]
            assert got[q] == want
    twice = spark.createDataFrame([(50, [3]), (50, [3]), (50, [-3]), (1, [1]), (2, [2])], "vec_id long, weights array<bigint>")
    assert sorted(map(tuple, topk.top_k(twice, twice.filter("vec_id = 50"), 1).collect())) == [(50, 1, 1, -3), (50, 1, 2, 6)]
    assert topk.top_k(own.limit(0), own, 5).count() == 0 and topk.top_k(own, own.limit(0), 5).count() == 0


def clipped(x):
    return max(-(1 << 63), min((1 << 63) - 1, x))


def struct_float(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


# ---- mixtures ----


def corpus(spark, rows):
    return spark.createDataFrame([(i, s, " ".join(["w"] * n) if n is not None else None, 1, "x") for i, s, n in rows], "doc_id long, source string, text string, full int, mix_last string")


def sizes():
    rnd, rows = random.Random(8), []
    for s, n in (("hot", 400), ("b", 60), ("c", 25), (None, 12)):
        rows += [(len(rows) + k, s, rnd.randrange(1, 60)) for k in range(n)]
    return rows


def test_mixture_reaches_its_weights(spark):
    rows = sizes()
    tokens, total = defaultdict(int), 0
    for _, s, n in rows:
        tokens[s or ""] += n
        total += n
    out = mixing.mix(corpus(spark, rows), max_repeats=3.0, entropy=0.9).select("doc_id", "source", "mix_epoch", "mix_order", "mix_block").collect()
    drawn, times = defaultdict(int), defaultdict(int)
    size = {i: n for i, _, n in rows}
    for r in out:
        drawn[r["source"] or ""] += size[r["doc_id"]]
        times[r["doc_id"]] += 1
        assert 0 <= r["mix_order"] <= 1
    sized = corpus(spark, rows).selectExpr("coalesce(source, '') AS source", "size(split(text, ' ')) AS n_tokens")
    table, budget = mixing.weights(sized, max_repeats=3.0, entropy=0.9)
    weights = {r["source"]: r for r in table.collect()}
    assert budget == total and math.isclose(sum(r["weight"] for r in weights.values()), 1, rel_tol=1e-6)
    assert all(r["epochs"] <= 3 + 1e-6 for r in weights.values())
    entropy = -sum(r["weight"] * math.log(r["weight"]) for r in weights.values())
    assert entropy >= 0.9 * math.log(4) - 1e-6 or max(r["epochs"] for r in weights.values()) > 3 - 1e-3
    largest = 60
    for s, r in weights.items():
        want = r["weight"] * budget
        assert want - largest <= drawn[s] <= want + 1e-6
        counts = {times[i] for i, t, _ in rows if (t or "") == s}
        assert counts <= {int(r["epochs"]), int(r["epochs"]) + 1}


def test_cover_takes_every_document(spark):
    rows = [*sizes(), (9001, "zero", 0), (9002, "zero", None)]
    out = mixing.mix(corpus(spark, rows), cover=True, max_repeats=2.0, entropy=None).select("doc_id").collect()
    times = defaultdict(int)
    for r in out:
        times[r["doc_id"]] += 1
    assert times.keys() == {r[0] for r in rows} and max(times.values()) <= 2


def test_mixing_edge_cases(spark):
    assert mixing.mix(corpus(spark, [])).count() == 0
    assert mixing.mix(corpus(spark, [(1, "a", 0), (2, None, None)])).count() == 2
    out = mixing.mix(corpus(spark, [(1, "a", 5), (1, "a", 5), (2, "a", 5), (3, "a", 5)]), budget=10).select("doc_id").collect()
    assert len(out) == 2 and {r["doc_id"] for r in out} in ({1}, {2, 3})
    assert sorted(mixing.mix(corpus(spark, [(1, "a", 5)])).columns) == sorted(["doc_id", "source", "text", "full", "mix_last", "mix_epoch", "mix_order", "mix_block"])


def test_archive_records_are_plain_gzip():
    import gzip

    assert gzip.GzipFile(fileobj=io.BytesIO(warc.record(1, None, b"x", 2))).read().startswith(b"WARC/1.1\r\nWARC-Type: revisit")


def test_columns_named_as_results_stay(spark):
    df = corpus(spark, [(1, "a", 5), (2, "b", 3)]).selectExpr("*", "7 AS Mix_Epoch", "8 AS mix_epoch_in")
    out = mixing.mix(df, cover=True)
    assert {"mix_epoch", "Mix_Epoch_in_in", "mix_epoch_in"} <= set(out.columns)
    assert {(r["Mix_Epoch_in_in"], r["mix_epoch_in"]) for r in out.collect()} == {(7, 8)}
    back = tables.given(out, df, mixing.RESULTS)
    assert back.columns == df.columns and {r["Mix_Epoch"] for r in back.collect()} == {7}
