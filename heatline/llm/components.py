"""Connected components by alternating large-star and small-star.

Every step is a grouped minimum and a join; the minima are written out first, so
the join deals both of its sides afresh and a node with very many neighbours can
be split over tasks.  The minima that a large-star begins with also tell whether the
edges are stars already, around the smallest node of each component: then no node
that has a smaller neighbour has another one.  So no round is made only to see that
nothing changes, and the last minima are the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables


def connected(links: DataFrame, scratch: tables.Scratch) -> DataFrame:
    """(node, component) of every linked node; ``links`` has x and y, a component is named by its smallest node.

    Steps are written to ``scratch``; the result reads the last of them.  Links may come
    twice and either way round.
    """
    edges = scratch.stage(links.filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")), "edges")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).select("a", F.least("lo", "a").alias("m"), F.expr("lo < a AND lo <> hi").alias("loose"))
        least = scratch.stage(least, "large_star_minima")
        if not least.agg(F.max("loose")).collect()[0][0]:
            return least.select(F.col("a").alias("node"), F.col("m").alias("component"))
        # One row for each edge at most, so repeated ones can wait for the small-star.
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = scratch.stage(large, "large_star")
        least = scratch.stage(large.groupBy("a").agg(F.min("b").alias("m")), "small_star_minima")
        moved = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = scratch.stage(moved.union(least.select("a", F.col("m").alias("b"))).distinct(), "small_star")
