"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import forget, stored


def connected_components(edges: DataFrame, settle: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """(id, label) of every node of edges (a, b), label the smallest id of its component.

    Alternating large-star and small-star: every round hooks each node's neighbours to its smallest neighbour, first the
    larger ones, then the smaller ones, until no edge changes; about log2 of the longest chain rounds. settle stores each
    round's edges. Minima are aggregated before the shuffle, and the join back is one that can be split.
    """
    canonical = lambda e: e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = settle(canonical(edges))
    before = mark(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = settle(canonical(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        was, now = now, settle(canonical(small.unionByName(least.select("a", F.col("m").alias("b")))))
        after = mark(now)
        if settle is stored:
            forget(was, large)
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(roots)
