"""Connected components of an edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .base import discard, staged


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every node that has an edge and is not the smallest of its component, with that smallest node.

    ``edges``: columns a and b of one orderable type; loops and repeated edges are allowed, an empty table gives an empty
    result. Every round is a few aggregates and joins on the edges; minima are taken by partial aggregation, and joins on
    a hub are split by adaptive execution, so no task ever holds a hub's neighbours. Rounds grow with the logarithm of
    a component's size. Each round's edges are written to the shared folder, so plans do not grow and lost executors
    repeat one round at most; a round's edges are deleted once the next ones are written.
    """
    e = staged(edges.filter(F.col("a") != F.col("b"))
               .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(e)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, e = e, staged(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        discard(last)
        before, state = state, _state(e)
        if state == before:
            return e
