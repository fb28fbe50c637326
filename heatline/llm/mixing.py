"""Mixing sources to target weights by temperature.

Source token shares p are raised to an exponent and normalised.  The exponent is
found by bisection (each pass over the share table tries ``POINTS`` exponents at
once) so that the weights' entropy reaches ``entropy`` of its largest value, or no
source repeats more than ``max_repeats`` times; where both are set, the limit on
repeats rules.  Weights times the budget give every source its tokens: whole epochs
of all its documents, then a part of one more.

Each epoch of a source is a permutation of its documents by a seeded hash.  The
last, partial one takes documents in that order while they fit the tokens left:
the permutation is cut in blocks (``FAN`` of them, the one at the edge in ``FAN``
again), block sums find where the edge lies, and only the documents of one small
block are ranked one by one.  ``mix_order`` deals all epochs of all sources evenly
over the run, ``mix_block`` numbers blocks of about ``block_tokens`` tokens.

Tokens are runs of non-space characters unless a column says otherwise.  Null text
has none, a null source is the source with the empty name.  Sources without tokens
weigh nothing, and their documents come once.  Rows that share a doc_id are taken
or left together.  An empty table gives no rows.  Other columns pass through; one that
is named as a result keeps its values under that name with ``_in`` behind it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tables

ENTROPY, MAX_REPEATS, BLOCK_TOKENS, SEED = 0.95, 4.0, 1_000_000, 17
POINTS, PASSES, FAN = 32, 6, 1024
#: Columns that ``mix`` adds.
RESULTS = ("mix_epoch", "mix_order", "mix_block")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _measures(shares: DataFrame, exponents: list[float]) -> list:
    """For each exponent: sum of p**a, sum of p**a * ln p, the smallest and largest p**(a - 1)."""
    tried = shares.filter("share > 0").select("share", F.explode(F.array(*[F.lit(float(x)) for x in exponents])).alias("a"))
    power = F.pow("share", F.col("a"))
    sums = tried.groupBy("a").agg(
        F.sum(power).alias("z"), F.sum(power * F.log("share")).alias("zl"), F.max(power / F.col("share")).alias("most"), F.min(power / F.col("share")).alias("least"), F.count(F.lit(1)).alias("n")
    )
    return sorted(sums.collect(), key=lambda r: r["a"])


def _budget(r, total: float, budget: float | None) -> float:
    """The tokens to draw: ``budget``, or, for None, what every source needs to come once at least."""
    return budget if budget is not None else total * r["z"] / r["least"]


def _fits(r, total: float, budget: float | None, entropy: float | None, max_repeats: float | None) -> tuple[bool, bool]:
    """Whether the entropy is high enough, and whether no source repeats too often."""
    h = math.log(r["z"]) - r["a"] * r["zl"] / r["z"]
    repeats = r["most"] / r["z"] * _budget(r, total, budget) / total
    return entropy is None or h >= entropy * math.log(r["n"]) - 1e-9, max_repeats is None or repeats <= max_repeats + 1e-9


def exponent(shares: DataFrame, total: float, *, budget: float | None, entropy: float | None = ENTROPY, max_repeats: float | None = MAX_REPEATS) -> float:
    """The largest exponent in [0, 1] with enough entropy, or the smallest within the repetition limit if that is larger."""
    found = []
    for which, wanted in ((0, entropy), (1, max_repeats)):
        if wanted is None:
            found.append(1.0 if which == 0 else 0.0)
            continue
        low, high = 0.0, 1.0
        for _ in range(PASSES):
            rows = _measures(shares, [low + (high - low) * k / POINTS for k in range(POINTS + 1)])
            good = [_fits(r, total, budget, entropy, max_repeats)[which] for r in rows]
            if which == 0:  # entropy falls as the exponent grows
                last = max((k for k, ok in enumerate(good) if ok), default=0)
                low, high = rows[last]["a"], rows[min(last + 1, POINTS)]["a"]
            else:  # and so do repeats
                first = min((k for k, ok in enumerate(good) if ok), default=POINTS)
                low, high = rows[max(first - 1, 0)]["a"], rows[first]["a"]
            if low == high or high - low < 1e-9:
                break
        found.append(low if which == 0 else high)
    return max(found)


def weights(sized: DataFrame, *, budget: float | None = None, cover: bool = False, entropy: float | None = ENTROPY, max_repeats: float | None = MAX_REPEATS) -> tuple[DataFrame, float]:
    """Per source: tokens, share, weight, epochs (may end in a part), full epochs and tokens left; and the whole budget.

    ``sized`` has source and n_tokens.  Without ``budget`` as many tokens are drawn as
    there are; with ``cover`` as many as let every source come once at least.
    """
    shares = tables.stage(sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "source_tokens")
    total = float(shares.agg(F.sum("tokens")).collect()[0][0] or 0)
    if not total:
        none = F.lit(0.0)
        return shares.select("source", "tokens", none.alias("share"), none.alias("weight"), none.alias("epochs"), F.lit(0).cast("long").alias("full"), none.alias("rest")), 0.0
    shares = shares.withColumn("share", F.col("tokens") / F.lit(total))
    asked = None if cover else float(budget) if budget is not None else total
    a = exponent(shares, total, budget=asked, entropy=entropy, max_repeats=max_repeats)
    r = _measures(shares, [a])[0]
    asked = _budget(r, total, asked)
    weight = F.when(F.col("share") > 0, F.pow("share", F.lit(a)) / F.lit(r["z"])).otherwise(0.0)
    out = shares.withColumn("weight", weight).withColumn("epochs", F.when(F.col("share") > 0, F.round(F.col("weight") * asked / F.col("tokens"), 9)).otherwise(0.0))
    out = out.withColumn("full", F.floor("epochs")).withColumn("rest", (F.col("epochs") - F.col("full")) * F.col("tokens"))
    return tables.stage(out.select("source", "tokens", "share", "weight", "epochs", "full", "rest"), "source_weights"), asked


def _rank(epoch: Column, doc_id: Column, seed: int) -> Column:
    """The document's place in this epoch's permutation, 0 to 2**62."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch.cast("long"), doc_id), 2)


def _edges(sized: DataFrame, table: DataFrame, seed: int) -> DataFrame:
    """source, full, epochs, tokens and the largest rank that the partial epoch takes (-1: none)."""
    ranked = sized.join(table, "source").filter("rest > 0").select("source", "rest", "n_tokens", _rank(F.col("full") + 1, F.col("doc_id"), seed).alias("rank"))
    edge = table.select("source", F.lit(0).cast("long").alias("edge"), F.col("rest").alias("left"))
    bits = 62
    for level in range(2):
        bits -= int(math.log2(FAN))
        inside = ranked if level == 0 else ranked.join(edge, "source").filter(F.shiftright("rank", bits + int(math.log2(FAN))) == F.col("edge"))
        sums = inside.groupBy("source", F.shiftright("rank", bits).alias("block")).agg(F.sum("n_tokens").alias("n"))
        order = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        reached = sums.withColumn("sum", F.sum("n").over(order)).join(edge, "source")
        crossing = reached.filter("sum > left").groupBy("source").agg(F.min_by(F.struct("block", (F.col("left") - F.col("sum") + F.col("n")).alias("left")), "block").alias("at"))
        # A source whose last epoch fits whole has no crossing; its edge lies behind every block.
        edge = table.join(crossing, "source", "left").select("source", F.coalesce("at.block", F.lit(1 << 62)).alias("edge"), F.coalesce("at.left", F.lit(0.0)).alias("left"))
        edge = tables.stage(edge, f"edge_{level}")
    leaf = ranked.join(edge, "source").filter(F.shiftright("rank", bits) == F.col("edge"))
    order = Window.partitionBy("source").orderBy("rank").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fit = leaf.withColumn("sum", F.sum("n_tokens").over(order)).filter("sum <= left").groupBy("source").agg(F.max("rank").alias("last"))
    block_start = F.when(F.col("edge") == 1 << 62, F.lit((1 << 62) - 1)).otherwise(F.shiftleft("edge", bits) - 1)
    last = edge.join(fit, "source", "left").select("source", F.coalesce("last", block_start).alias("last"))
    out = table.join(last, "source").select("source", "full", "epochs", "tokens", F.when(F.col("rest") > 0, F.col("last")).otherwise(-1).alias("last"))
    return tables.stage(out, "source_edges")


def mix(
    df: DataFrame,
    *,
    doc_id: str = "doc_id",
    source: str = "source",
    tokens: Column | None = None,
    budget: float | None = None,
    cover: bool = False,
    entropy: float | None = ENTROPY,
    max_repeats: float | None = MAX_REPEATS,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = SEED,
) -> DataFrame:
    """The rows of ``df``, each as often as the mixture takes it, with mix_epoch, mix_order and mix_block."""
    own_source = F.coalesce(F.col(source), F.lit(""))
    n_tokens = words(F.col("text")) if tokens is None else tokens
    sized = tables.stage(df.select(F.col(doc_id).alias("doc_id"), own_source.alias("source"), n_tokens.alias("n_tokens")), "sized")
    table, drawn = weights(sized, budget=budget, cover=cover, entropy=entropy, max_repeats=max_repeats)
    df, names = tables.set_aside(df, RESULTS)
    doc_id, own_source = f"`{names[doc_id]}`", F.coalesce(F.col(f"`{names[source]}`"), F.lit(""))
    own = tables.fresh(df, "mix_")
    edges = _edges(sized, table, seed).select(*[F.col(c).alias(own + c) for c in ("source", "full", "epochs", "tokens", "last")])
    rows = df.join(edges, own_source == F.col(own + "source"))
    full, epochs = F.col(own + "full"), F.col(own + "epochs")
    extra = (_rank(full + 1, F.col(doc_id), seed) <= F.col(own + "last")).cast("long")
    times = F.when(F.col(own + "tokens") > 0, full + F.coalesce(extra, F.lit(0))).otherwise(1)
    rows = rows.withColumn("mix_epoch", F.explode(F.when(times > 0, F.sequence(F.lit(1).cast("long"), times))))
    place = (F.col("mix_epoch") - 1 + _rank(F.col("mix_epoch"), F.col(doc_id), seed) / F.lit(float(1 << 62))) / F.greatest(epochs, F.lit(1e-9))
    blocks = max(1, math.ceil(drawn / block_tokens))
    rows = rows.withColumn("mix_order", F.least(place, F.lit(1.0))).withColumn("mix_block", F.least(F.floor(F.col("mix_order") * blocks), F.lit(blocks - 1)).cast("long"))
    return rows.drop(*edges.columns)
