"""Circular block bootstrap of the mean IC, all factors and resamples at once.

Draws come from md5 of (seed, resample, block): the same on every engine, every
retry and any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..columns import DATE, FACTOR
from ..session import cut

c = F.col
#: Resamples that one task draws.
PER_TASK = 2000


def draw(resample: Column, block: Column, n: Column, seed: int) -> Column:
    """Uniform start in [0, n) for one block of one resample."""
    text = F.concat_ws(":", F.lit(str(seed)), resample.cast("string"), block.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n


def _series(daily: DataFrame) -> DataFrame:
    """Per factor (calendar-bounded): mean IC, block size and prefix sums of the centred series laid end to end twice."""
    whole = Window.partitionBy(FACTOR)
    running = whole.orderBy(DATE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    centred = daily.withColumn("_c", c("ic") - F.avg("ic").over(whole)).withColumn("_p", F.sum("_c").over(running))
    packed = centred.groupBy(FACTOR).agg(
        F.sort_array(F.collect_list(F.struct(DATE, "_p"))).alias("_s"), F.avg("ic").alias("real_ic")
    )
    once = F.transform("_s", lambda s: s["_p"])
    n = F.size("_s")
    return packed.select(
        FACTOR,
        "real_ic",
        n.cast("long").alias("n"),
        # any circular block is one difference of these
        F.concat(F.array(F.lit(0.0)), once, F.transform(once, lambda p: p + F.element_at("_s", -1)["_p"])).alias("prefix"),
        F.least(n, F.greatest(F.lit(5), F.round(F.sqrt(n)).cast("int"))).cast("long").alias("block_size"),
    )


def null_means(daily: DataFrame, resamples: int = 100_000, seed: int = 42) -> DataFrame:
    """(factor_id, real_ic, n, block_size, resample, null_ic); a series under 10 days gives one row without null_ic."""
    series = _series(daily.where(c("ic").isNotNull()))
    short = series.where(c("n") < 10).select(
        FACTOR, "real_ic", "n", "block_size", F.lit(None).cast("long").alias("resample"), F.lit(None).cast("double").alias("null_ic")
    )
    series = cut(series.where(c("n") >= 10))
    # A resample's block starts depend on the length alone: drawn once for each length, used by every factor of it.
    lengths = series.groupBy("n", "block_size").agg(F.count(F.lit(1)).alias("_factors"))
    blocks = F.ceil(c("n") / c("block_size"))
    numbers = daily.sparkSession.range(0, resamples, 1, max(1, -(-resamples // PER_TASK))).withColumnRenamed("id", "resample")
    drawn = numbers.withColumn("_one", F.lit(1)).join(F.broadcast(lengths.withColumn("_one", F.lit(1))), "_one")
    starts = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda b: draw(c("resample"), b, c("n"), seed))
    drawn = drawn.select("resample", "n", "block_size", starts.alias("_starts"))

    def block_sum(start: Column, b: Column) -> Column:
        length = F.least(c("block_size"), c("n") - b * c("block_size"))
        return F.get("prefix", (start + length).cast("int")) - F.get("prefix", start.cast("int"))

    # One row per factor, as long as the calendar: bounded like every table of factors.
    met = drawn.join(F.broadcast(series), ["n", "block_size"])
    total = F.aggregate(F.transform("_starts", block_sum), F.lit(0.0), lambda acc, x: acc + x)
    return met.select(FACTOR, "real_ic", "n", "block_size", "resample", (total / c("n")).alias("null_ic")).unionByName(short)


def bootstrap_significance(daily: DataFrame, resamples: int = 100_000, seed: int = 42) -> DataFrame:
    """Two-sided p-value and percentile of the real mean IC per factor."""
    x, m = c("null_ic"), c("real_ic")
    share = lambda hit: F.avg(F.when(x.isNotNull(), F.when(hit, 1.0).otherwise(0.0)))
    agg = null_means(daily, resamples, seed).groupBy(FACTOR).agg(
        F.max(F.when(x.isNotNull(), m)).alias("real_ic"),
        F.coalesce(share(F.abs(x) >= F.abs(m)), F.lit(1.0)).alias("p"),
        F.avg(x).alias("null_mean"),
        F.stddev_pop(x).alias("null_std"),
        (share(x < m) * 100).alias("percentile"),
        F.count(x).alias("n_bootstrap"),
        F.max(F.when(x.isNotNull(), c("block_size"))).alias("block_size"),
    )
    known = lambda name, digits, other: F.round(F.coalesce(name, F.lit(other)), digits).alias(name)
    return agg.select(
        FACTOR,
        known("real_ic", 6, 0.0),
        F.round("p", 6).alias("p_value"),
        known("null_mean", 6, 0.0),
        known("null_std", 6, 0.0),
        known("percentile", 1, 50.0),
        (c("p") < 0.01).alias("significant_01"),
        (c("p") < 0.05).alias("significant_05"),
        "n_bootstrap",
        F.coalesce("block_size", F.lit(0)).alias("block_size"),
    )
