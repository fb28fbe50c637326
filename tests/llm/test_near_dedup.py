"""MinHash groups against brute force over all pairs."""

import random

from heatline.llm import components, near_dedup, tables

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, bucket int, component string"


def shingle_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in SPACE:
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_force(rows):
    sets = {d: shingle_set(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], SCHEMA)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_groups(df).collect()}


def test_groups_equal_brute_force(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 7)))
    rows, n = [], 0
    shared = " ".join(word() for _ in range(40))
    for _ in range(25):
        base = [word() for _ in range(rnd.choice([3, 30, 120, 300]))]
        for _ in range(rnd.randrange(1, 9)):
            copy = list(base)
            for _ in range(rnd.randrange(0, 1 + len(copy) // 25)):
                copy[rnd.randrange(len(copy))] = word()
            sep = rnd.choice([" ", "  ", "\n", "\t "])
            rows.append((n, sep.join(copy).upper() if rnd.random() < 0.2 and "é" not in "".join(copy) else sep.join(copy)))
            n += 1
        rows.append((n, shared + " " + " ".join(word() for _ in range(30))))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "a b c d"), (n + 6, "a b c d e"), (n + 7, "w " * 3000)]
    got = run(spark, rows)
    want = brute_force(rows)
    assert got == {d: (k, c, c == d) for d, (k, c) in want.items()}


def test_a_chain_of_copies_is_one_group(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(100 - k, " ".join(words[: 5 * k] and [f"x{i}" for i in range(5 * k)] + words[5 * k :])) for k in range(1, 12)]
    rows.append((100, " ".join(words)))
    assert run(spark, rows) == {d: (k, c, c == d) for d, (k, c) in brute_force(rows).items()}


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(links, "x long, y long"), tables.Scratch(spark, "test")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert components.connected(spark.createDataFrame([], "x long, y long"), tables.Scratch(spark, "test")).count() == 0


def test_wide_buckets_lose_no_link(spark, monkeypatch):
    """One bucket of many components, in blocks of a few documents, and a component with many that ask for it."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "LINK_BLOCK", 4)
    monkeypatch.setattr(near_dedup, "HUBS", 1)
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(240):
        own = list(words)
        for k in range(rnd.choice([0, 1, 1, 2, 2, 3])):
            own[rnd.randrange(60)] = f"x{i}_{k}"
        texts.append(" ".join(own))
    rows = list(enumerate(texts))
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_force(rows)


def test_staged_tables_are_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "shared_dir", lambda spark: str(tmp_path))
    near_dedup.near_groups(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")], "doc_id long, text string")).collect()
    assert sorted(p.name.split("-", 1)[1] for p in tmp_path.glob("*/near_groups/*")) == ["components", "profiles"]


def test_stars_need_no_round_to_be_seen(spark, tmp_path, monkeypatch):
    """Links that are stars around their smallest nodes, also given twice and turned round, are written and looked at once."""
    monkeypatch.setattr(tables, "shared_dir", lambda spark: str(tmp_path))
    links = [(100, 100 + i) for i in range(1, 30)] + [(8, 7), (7, 8), (7, 9), (5, 5)]
    scratch = tables.Scratch(spark, "test")
    got = sorted(tuple(r) for r in components.connected(spark.createDataFrame(links, "x long, y long"), scratch).select("node", "component").collect())
    assert got == [(7, 7), (8, 7), (9, 7)] + [(100 + i, 100) for i in range(30)]
    assert scratch.written == ["edges", "large_star_minima"]
    path = tables.Scratch(spark, "test")  # 2-1-3: one round, and its stars aren't run through another
    assert {tuple(r) for r in components.connected(spark.createDataFrame([(2, 1), (2, 3)], "x long, y long"), path).select("node", "component").collect()} == {(1, 1), (2, 1), (3, 1)}
    assert path.written == ["edges", "large_star_minima", "large_star", "small_star_minima", "small_star", "large_star_minima"]


def test_copies_in_many_components_take_few_tables(spark, tmp_path, monkeypatch):
    """Each written table costs a task and a file for every partition: on check_h, of 211 partitions, those of both searches for components were most of the time."""
    monkeypatch.setattr(tables, "shared_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(near_dedup, "HUBS", 1)
    written = []
    stage = tables.Scratch.stage
    monkeypatch.setattr(tables.Scratch, "stage", lambda self, df, name, *a: (written.append(name), stage(self, df, name, *a))[1])
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        own = list(words)
        for k in range(rnd.choice([0, 1, 1, 2, 2, 3])):
            own[rnd.randrange(60)] = f"x{i}_{k}"
        rows.append((i, " ".join(own)))
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_force(rows)
    assert "links_across" in written and written.count("edges") == 2
    assert len(written) - sum(written.count(x) for x in ("large_star_minima", "large_star", "small_star_minima", "small_star")) <= 20
