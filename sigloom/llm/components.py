"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (x, y): comp is the smallest node that can be reached.

    Each step is a group-by for the smallest neighbour, folded in each task,
    and a join back, in which Spark splits a node with very many neighbours
    (an adaptive skew join: nothing above it needs a node's rows together). The
    number of rounds grows with the logarithm of the nodes.
    """
    now = stored(edges.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        large = stored(_star(now.union(now.select("v", "u")).toDF("u", "v"), larger=True))
        after, before = stored(_star(large, larger=False)), mark
        discard(now, large)
        now = after
        mark = _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(now.select("v", "v").distinct())


def _mark(pairs: DataFrame) -> tuple:
    """Number and hash sums of the rows: equal for equal tables, whatever their order."""
    half = lambda seed: F.sum(F.xxhash64(F.lit(seed), "u", "v").cast("decimal(20,0)"))
    return tuple(pairs.agg(F.count(F.lit(1)), half(1), half(2)).first())


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Link the neighbours of each u that are larger (or not larger) than u to u's smallest neighbour."""
    if not larger:
        pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    linked = pairs.join(lowest, "u").where("v > u" if larger else "v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    if larger:
        return linked.where("u <> v")  # the small star that follows drops repeated pairs
    return linked.union(lowest.where("u <> low").select("u", "low")).where("u <> v").distinct()
