"""Near-duplicate groups by MinHash.

1. One pass over the texts gives each document its number of distinct word
   shingles, a 128-bit key of the whole set, ``BANDS`` band keys of ``ROWS`` universal
   hash minima each, and one byte of every minimum as its signature.
2. Documents with equal sets fall into one class, stood for by its smallest id.
3. Classes that share a band key are candidates.  In the first round every member
   of a bucket is compared with the bucket's ``HUBS`` hubs only, and with a hub of
   several buckets once.  Signatures thin the pairs, and links are confirmed on the
   full sets, recomputed from the whole texts.
4. Large-star and small-star turn links into components.  Buckets whose members
   are in several components then compare signatures across components, in blocks of
   bounded size, which gives the documents still to be compared with some larger
   component.  Each is held against the members of that component, block by block,
   until a link is confirmed; components are found once more, with components as nodes.

Pairs inside a component need no look and no pair is written for a member of a
component, so a group of n near copies costs about n rows, yet every candidate link
between two components is tested or made needless by another between them.

A link at the threshold 0.75 shares no band with probability (1 - 0.75**4)**32, about
5e-6, and fails the signature test with about 3e-7; longer sets make no difference.
Sets are taken for equal on their 128-bit keys: two different ones of 10**10 share a key
with a probability of about 1e-19.  A bucket of n classes, of which o lie outside its main
component, costs about 2 * n * o / BLOCK rows and n * o signature comparisons.

Null and empty texts, and those of white space only, have no shingles: they are
linked with nothing and kept.  Rows that repeat a doc_id with its text get the same
result; doc_ids must not stand for different texts.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import components, shingles, tables, textnum, tokens

WIDTH, BANDS, ROWS, SEED = 5, 32, 4, 20_240_229
#: A link has 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Standard deviations below the threshold at which a signature still passes.
SLACK = 5.0
BLOCK, LINK_BLOCK, HUBS = 512, 256, 4
#: Pairs that a task remembers, so as not to give them out twice.
SEEN = 1 << 18
#: How a document of an open bucket is sent: in its main component, outside it, and outside and asking.
INSIDE, OUTSIDE, ASKING = 0, 1, 2
PROFILE = "doc_id long, n_shingles long, set_hi long, set_lo long, bands array<long>, signature binary"
PAIR = "x long, y long"


def _least_matches(percent: int) -> int:
    n, p = BANDS * ROWS, percent / 100
    return max(0, math.floor(n * p - SLACK * math.sqrt(n * p * (1 - p))))


def _profiles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    tokens.release()
    family = shingles.hash_family(BANDS * ROWS, SEED)
    step = np.uint64(0x9E3779B97F4A7C15)
    for b in batches:
        for i, texts in textnum.byte_slices(b.column(1)):
            sets, bounds = shingles.shingle_sets(texts, width)
            minima = shingles.signatures(sets, bounds, family)
            size = np.diff(bounds)
            some = size > 0
            keys = []
            for seed in (0x2545F4914F6CDD1D, 0x632BE59BD9B4E019):  # order is fixed by the sort, so position may count
                place = textnum.mix((np.arange(len(sets)) - np.repeat(bounds[:-1], size)).astype(np.uint64) * step + np.uint64(seed))
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textnum.mix(sets ^ place), dtype=np.uint64)])
                keys.append(pa.array(textnum.mix(sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64), mask=~some))
            bands = np.empty((len(size), BANDS), np.uint64)
            for k in range(BANDS):
                h = np.full(len(size), k + 1, np.uint64)
                for row in minima[k * ROWS : (k + 1) * ROWS]:
                    h = textnum.mix(h * step + row.astype(np.uint64))
                bands[:, k] = h
            at = pa.array(np.arange(0, BANDS * (len(size) + 1), BANDS, dtype=np.int32))
            low = np.ascontiguousarray((minima & np.uint32(255)).astype(np.uint8).T)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, len(texts)), pa.array(size), *keys, pa.ListArray.from_arrays(at, pa.array(bands.view(np.int64).ravel())), pa.array([x.tobytes() for x in low], pa.binary())],
                names=[x.split(" ")[0] for x in PROFILE.split(", ")],
            )


def _signature_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _similar_signatures(held: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y, n) of a document and one of its hubs, x < y, whose sizes and signatures allow a link; ``held`` has each document's hubs."""
    least = _least_matches(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                alike = (_signature_rows(b.column(2)) == _signature_rows(b.column(3))).sum(1) >= least
                yield b.select([0, 1, 4]).filter(pa.array(alike))

    own = held.select("doc_id", F.col("n_shingles").alias("nx"), F.col("signature").alias("sx"), "n", F.explode("hubs").alias("hub")).filter("doc_id <> hub")
    other = classes.select(F.col("doc_id").alias("hub"), F.col("n_shingles").alias("ny"), F.col("signature").alias("sy"))
    sized = own.join(other, "hub").filter(f"100 * least(nx, ny) >= {percent} * greatest(nx, ny)")
    alike = sized.select(F.least("doc_id", "hub").alias("x"), F.greatest("doc_id", "hub").alias("y"), "sx", "sy", "n").mapInArrow(run, PAIR + ", n long")
    return alike.groupBy("x", "y").agg(F.max("n").alias("n"))  # two hubs may have each other


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs linked by their full sets.  Each left text is sent once for about every ``BLOCK`` of its partners, which stream past it.

    ``n`` of a pair, the size of y's or x's largest bucket, bounds how many pairs one of its hubs is in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = np.empty(0, np.uint64)
        for b in batches:
            found: list[tuple[int, int]] = []
            xs, roles, docs = (b.column(k).to_pylist() for k in (0, 2, 3))
            for i, part in textnum.byte_slices(b.column(4)):
                sets, bounds = shingles.shingle_sets(part, width)
                for k in range(len(part)):
                    own = sets[bounds[k] : bounds[k + 1]]
                    if roles[i + k] == 0:
                        left = own.copy()
                    else:
                        shared = shingles.overlap(left, own)
                        if 100 * shared >= percent * (len(left) + len(own) - shared):
                            found.append((xs[i + k], docs[i + k]))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["x", "y"])

    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("y"), F.ceil(F.col("n") / BLOCK)))
    asked = salted.select("x", "salt", F.lit(0).alias("role"), F.col("x").alias("doc")).distinct().union(salted.select("x", "salt", F.lit(1).alias("role"), F.col("y").alias("doc")))
    rows = asked.join(texts.select("doc", "text"), "doc").select("x", "salt", "role", "doc", "text")
    return rows.repartition("x", "salt").sortWithinPartitions("x", "salt", "role", "doc").mapInArrow(run, PAIR)


def _across(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(x, own, component): documents that may be linked with some member of another component than their own, a larger one.

    Takes one pair of blocks of a bucket after the other: one of documents outside the
    bucket's main component and one of any members.  Two documents that share several
    buckets are looked at in the first of them only, and two from outside once.
    """
    least = _least_matches(percent)
    key, held = None, []
    seen: set[tuple[int, int, int]] = set()

    def compare() -> Iterator[pa.RecordBatch]:
        role, doc, size, comp, members = (np.array([r[k] for r in held]) for k in range(5))
        asking, own = np.flatnonzero(role == ASKING), np.flatnonzero(role != ASKING)
        if not len(asking) or not len(own):
            return
        sig = np.frombuffer(b"".join(r[5] for r in held), np.uint8).reshape(len(held), -1)
        bands = np.array([r[6] for r in held], np.int32)
        earlier = bands[:, : int((bands == key[0] >> 32).all(0).argmax())]
        asked: set[tuple[int, int, int]] = set()
        for i in asking:
            ok = (comp[own] != comp[i]) & (100 * np.minimum(size[own], size[i]) >= percent * np.maximum(size[own], size[i]))
            at = own[ok & ((role[own] == INSIDE) | (doc[own] > doc[i]))]
            at = at[(sig[at] == sig[i]).sum(1) >= least]
            at = at[~(earlier[at] == earlier[i]).any(1)]
            larger = (members[at] > members[i]) | ((members[at] == members[i]) & (comp[at] < comp[i]))
            asked.update((int(doc[i]), int(comp[i]), int(c)) for c in np.unique(comp[at[larger]]))
            asked.update((int(doc[k]), int(comp[k]), int(comp[i])) for k in at[~larger])
        asked -= seen
        if len(seen) > SEEN:
            seen.clear()
        seen.update(asked)
        if asked:
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in asked], pa.int64()) for k in range(3)], names=["x", "own", "component"])

    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        for bucket, low, high, *row in zip(*columns, strict=True):
            if (bucket, low, high) != key:
                if held:
                    yield from compare()
                key, held = (bucket, low, high), []
            held.append(row)
    if held:
        yield from compare()


def _across_components(members: DataFrame, classes: DataFrame, labels: DataFrame, sizes: DataFrame, percent: int, scratch: tables.Scratch) -> DataFrame:
    """Distinct (x, own, component) still to be compared; ``labels`` has node and component, ``sizes`` component and members.

    In a bucket with several components, every document outside the bucket's main one
    (the largest component that any of its members is in) meets every member.
    """
    labelled = labels.join(sizes, "component")
    named = members.join(labelled, members["doc_id"] == labelled["node"], "left").select(
        "bucket", "n", "doc_id", F.coalesce("component", "doc_id").alias("component"), F.coalesce("members", F.lit(1).cast("long")).alias("members")
    )
    named = scratch.stage(named, "members_named")
    shares = named.groupBy("bucket", "component").agg(F.max("n").alias("n"), F.max("members").alias("members"), F.count(F.lit(1)).alias("share"))
    found = shares.groupBy("bucket").agg(F.max("n").alias("n"), F.max(F.struct("members", "component", "share")).alias("main")).filter("n > main.share")
    found = found.select("bucket", F.col("main.component").alias("main"), F.ceil((F.col("n") - F.col("main.share")) / BLOCK).alias("outside"))
    open_buckets = scratch.stage(found, "open_buckets")
    rows = named.join(open_buckets, "bucket").withColumn("out", F.col("component") != F.col("main"))
    rows = rows.join(classes.select("doc_id", "n_shingles", "signature", F.transform("bands", lambda b: F.shiftright(b, 32).cast("int")).alias("bands")), "doc_id")
    blocks = F.ceil(F.col("n") / BLOCK)
    # An outside block is low, a block of any members high; an outside document comes as both.
    all_low, all_high = F.sequence(F.lit(0).cast("long"), F.col("outside") - 1), F.sequence(F.lit(0).cast("long"), blocks - 1)
    own_low, own_high = F.pmod(F.xxhash64("doc_id"), F.col("outside")), F.pmod(F.xxhash64("doc_id"), blocks)
    as_member = F.transform(all_low, lambda k: F.struct(k.alias("low"), own_high.alias("high"), F.when(F.col("out"), OUTSIDE).otherwise(INSIDE).alias("role")))
    as_outside = F.transform(all_high, lambda k: F.struct(own_low.alias("low"), k.alias("high"), F.lit(ASKING).alias("role")))
    sent = rows.withColumn("to", F.explode(F.when(F.col("out"), F.concat(as_member, as_outside)).otherwise(as_member)))
    dealt = sent.select("bucket", "to.low", "to.high", "to.role", "doc_id", "n_shingles", "component", "members", "signature", "bands")
    dealt = dealt.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    return dealt.mapInArrow(lambda b: _across(b, percent), "x long, own long, component long").distinct()


def _components_linked(asked: DataFrame, labels: DataFrame, sizes: DataFrame, texts: DataFrame, width: int, percent: int, scratch: tables.Scratch) -> DataFrame:
    """(x, y): of each asked pair of components, own and other, those between which the full sets confirm a link.

    A component's members are sent in blocks, once for every ``LINK_BLOCK`` of documents that
    ask for it; each x is sent to every block and compared with the members whose
    signatures allow a link, until one is confirmed.  In a task the others of its own
    component need no look after that.
    """
    least = _least_matches(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside = None, []
        for b in batches:
            found: list[tuple[int, int]] = []
            comps, blocks, salts, roles, docs, owns, sigs = (b.column(k).to_pylist() for k in range(7))
            for i, part in textnum.byte_slices(b.column(7)):
                sets, bounds = shingles.shingle_sets(part, width)
                for k in range(len(part)):
                    own, sig = sets[bounds[k] : bounds[k + 1]], np.frombuffer(sigs[i + k], np.uint8)
                    if (comps[i + k], blocks[i + k], salts[i + k]) != key:
                        key, inside, stacked, joined = (comps[i + k], blocks[i + k], salts[i + k]), [], None, set()
                    if roles[i + k] == 0:
                        inside.append((own.copy(), sig))
                        continue
                    if not inside or owns[i + k] in joined:
                        continue
                    if stacked is None:
                        stacked = np.stack([s for _, s in inside])
                    alike = (stacked == sig).sum(1)
                    for m in np.argsort(-alike, kind="stable"):
                        if alike[m] < least:
                            break
                        other = inside[m][0]
                        if 100 * min(len(own), len(other)) < percent * max(len(own), len(other)):
                            continue
                        shared = shingles.overlap(own, other)
                        if 100 * shared >= percent * (len(own) + len(other) - shared):
                            found.append((owns[i + k], comps[i + k]))
                            joined.add(owns[i + k])
                            break
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["x", "y"])

    # A component of one document isn't among the labels; it is its own only member.
    wanted = asked.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / LINK_BLOCK).alias("askers")).join(sizes, "component", "left")
    wanted = scratch.stage(wanted.select("component", "askers", F.ceil(F.coalesce("members", F.lit(1)) / LINK_BLOCK).alias("blocks")), "components_asked")
    own = wanted.join(labels, "component", "left").select("component", "askers", "blocks", F.coalesce("node", "component").alias("doc"))

    def every(upto: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(upto) - 1))

    inside = own.select("component", F.pmod(F.xxhash64("doc"), F.col("blocks")).alias("block"), every("askers").alias("salt"), F.lit(0).alias("role"), "doc", F.col("component").alias("own"))
    outside = asked.join(wanted, "component").select("component", every("blocks").alias("block"), F.pmod(F.xxhash64("x"), F.col("askers")).alias("salt"), F.lit(1).alias("role"), F.col("x").alias("doc"), "own")
    rows = inside.union(outside).join(texts, "doc").select("component", "block", "salt", "role", "doc", "own", "signature", "text")
    return rows.repartition("component", "block", "salt").sortWithinPartitions("component", "block", "salt", "role", "doc").mapInArrow(run, PAIR)


def near_groups(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept."""
    docs = tables.small_batches(df).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scratch = tables.Scratch(df.sparkSession, "near_groups")
    profiles = scratch.stage(docs.mapInArrow(lambda b: _profiles(b, width), PROFILE), "profiles")
    classes = profiles.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_hi", "set_lo")
    classes = classes.agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "signature")])
    classes = scratch.stage(classes, "classes")

    banded = classes.select("doc_id", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = scratch.stage(buckets, "buckets")
    members = scratch.stage(banded.join(buckets, "bucket"), "members")
    hubs = members.groupBy("bucket").agg(*[F.min_by("doc_id", F.xxhash64("doc_id", F.lit(k))).alias(f"hub_{k}") for k in range(HUBS)])
    hubs = scratch.stage(hubs.select("bucket", F.array_distinct(F.array(*[f"hub_{k}" for k in range(HUBS)])).alias("hubs")), "hubs")
    # A document is in BANDS buckets at most, so what is gathered for it is bounded.
    held = members.join(hubs, "bucket").groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("hubs"))).alias("hubs"), F.max("n").alias("n"))
    held = scratch.stage(held.join(classes.select("doc_id", "n_shingles", "signature"), "doc_id"), "candidates")
    # Ids alone, so that texts of no candidate need not be shuffled while the ids can be broadcast.
    ids = scratch.stage(held.select(F.col("doc_id").alias("doc")), "candidate_ids")
    texts = docs.withColumnRenamed("doc_id", "doc").join(ids, "doc", "left_semi").dropDuplicates(["doc"])
    texts = scratch.stage(texts.join(held.select(F.col("doc_id").alias("doc"), "signature"), "doc"), "candidate_texts")

    pairs = scratch.stage(_similar_signatures(held, classes, percent), "pairs")
    links = scratch.stage(_confirmed(pairs, texts, width, percent), "links")
    labels = components.connected(links, scratch)
    sizes = scratch.stage(labels.groupBy("component").agg(F.count(F.lit(1)).alias("members")), "component_sizes")
    asked = scratch.stage(_across_components(members, classes, labels, sizes, percent, scratch), "asked")
    named = classes.join(labels, classes["doc_id"] == labels["node"], "left").select("set_hi", "set_lo", "copies", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    if not asked.isEmpty():
        found = scratch.stage(_components_linked(asked, labels, sizes, texts, width, percent, scratch), "links_across")
        merged = components.connected(found, scratch).select(F.col("node").alias("component"), F.col("component").alias("whole"))
        named = named.join(merged, "component", "left").withColumn("component", F.coalesce("whole", "component"))
    named = scratch.stage(named.filter("copies > 1 OR component <> doc_id").select("set_hi", "set_lo", "component"), "components")
    scratch.drop("profiles", "components")
    out = profiles.select("doc_id", "n_shingles", "set_hi", "set_lo").join(named, ["set_hi", "set_lo"], "left")
    component = F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_copies(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` that stay: one document of every group."""
    gone = near_groups(df, doc_id=doc_id, text=text, width=width, percent=percent).filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    gone = tables.stage(gone, "near_copies_gone")
    return df.join(gone, df[doc_id] == gone["_gone"], "left_anti")
