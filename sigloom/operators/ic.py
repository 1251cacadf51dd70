"""Rank information coefficients of long signals (factor_id, symbol, date, value, target)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..columns import DATE, FACTOR, VALUE
from ..functions.scalar import pearson, ratio, share_true
from . import ranking

c = F.col


def pair_ranks(
    df: DataFrame, target: str, by=(FACTOR,), width: int | None = None, keep_missing: bool = False
) -> DataFrame:
    """Rows with both value and target, with order statistics ``v_*`` and ``t_*`` per (by, date).

    One shuffle by (by, date) serves both rankings and every aggregate after
    them.  ``keep_missing`` keeps incomplete rows, unranked, so that dates
    without any pair stay visible to those aggregates.
    """
    keys = [*by, DATE]
    both = c(VALUE).isNotNull() & c(target).isNotNull()
    if keep_missing:
        df = df.withColumns({"_v": F.when(both, c(VALUE)), "_t": F.when(both, c(target))})
        ranked = ranking.order_stats(df, keys, "_v", "v", width)
        return ranking.order_stats(ranked, keys, "_t", "t", width).drop("_v", "_t")
    ranked = ranking.order_stats(df.where(both), keys, VALUE, "v", width)
    return ranking.order_stats(ranked, keys, target, "t", width)


def rank_correlation() -> Column:
    """Spearman aggregate over ``pair_ranks`` columns."""
    return pearson(ranking.average_rank("v"), ranking.average_rank("t"))


def daily_ic(
    df: DataFrame,
    target: str = "fwd_5",
    by=(FACTOR,),
    at_least: int = 10,
    undefined: str = "drop",
    width: int | None = None,
) -> DataFrame:
    """IC per (by, date) with at least ``at_least`` names.

    ``undefined`` says what a constant factor or target gives: "drop" the date,
    "keep" it with a NULL ic, or "zero".
    """
    keys = [*by, DATE]
    out = (
        pair_ranks(df, target, by, width)
        .groupBy(*keys)
        .agg(rank_correlation().alias("ic"), F.count(F.lit(1)).alias("n_stocks"))
        .where(c("n_stocks") >= at_least)
    )
    if undefined == "drop":
        return out.where(c("ic").isNotNull())
    if undefined == "zero":
        return out.withColumn("ic", F.coalesce("ic", F.lit(0.0)))
    return out


def information_ratio(mean: Column, sd: Column) -> Column:
    return F.when(sd > 1e-10, ratio(mean, sd)).otherwise(0.0)


def ic_summary(daily: DataFrame, by=(FACTOR,)) -> DataFrame:
    ic = c("ic")
    return (
        daily.groupBy(*by)
        .agg(
            F.avg(ic).alias("_m"),
            F.stddev_samp(ic).alias("_s"),
            share_true(ic > 0).alias("_p"),
            F.count(ic).alias("n_days"),
        )
        .select(
            *by,
            F.round("_m", 4).alias("ic_mean"),
            F.round("_s", 4).alias("ic_std"),
            F.round(information_ratio(c("_m"), c("_s")), 3).alias("ic_ir"),
            F.round(c("_p") * 100, 1).alias("ic_positive_pct"),
            "n_days",
        )
    )


REGIMES = {0.0: "trending", 1.0: "mean_reverting", 2.0: "noisy"}


def ic_by_regime(
    df: DataFrame, target: str, regime: str = "regime", width: int | None = None, daily: DataFrame | None = None
) -> DataFrame:
    """IC mean and ratio (population deviation) per factor and regime; under 20 rows gives NULLs. ``daily``: the ic by (factor, regime, date), where at hand."""
    by = [FACTOR, regime]
    pairs = df.where(c(VALUE).isNotNull() & c(target).isNotNull() & c(regime).isNotNull())
    rows = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    stats = (
        (daily_ic(pairs, target, by, width=width) if daily is None else daily)
        .groupBy(*by)
        .agg(F.avg("ic").alias("_m"), F.stddev_pop("ic").alias("_s"), F.count("ic").alias("_days"))
    )
    wanted = df.select(FACTOR).distinct().select(
        FACTOR, F.explode(F.array(*[F.lit(k) for k in REGIMES])).alias(regime)
    )
    names = F.create_map(*[F.lit(x) for kv in REGIMES.items() for x in kv])
    enough = F.coalesce(c("_rows"), F.lit(0)) >= 20
    return (
        wanted.join(rows, by, "left")
        .join(stats, by, "left")
        .select(
            FACTOR,
            names[c(regime)].alias("regime"),
            F.round(F.when(enough, c("_m")), 4).alias("ic_mean"),
            F.round(F.when(enough & (c("_days") > 0), information_ratio(c("_m"), c("_s"))), 3).alias("ic_ir"),
            F.when(enough, F.coalesce("_days", F.lit(0))).otherwise(F.coalesce("_rows", F.lit(0))).alias("n_obs"),
        )
    )


def rolling_ic(daily: DataFrame, window: int = 60, by=(FACTOR,)) -> DataFrame:
    """Rolling mean IC (at least half a window) and expanding mean; series are calendar-bounded."""
    order = Window.partitionBy(*by).orderBy(DATE)
    recent = order.rowsBetween(-(window - 1), Window.currentRow)
    ever = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    enough = F.count("ic").over(recent) >= max(1, window // 2)
    return daily.where(c("ic").isNotNull()).select(
        *by,
        DATE,
        F.when(enough, F.avg("ic").over(recent)).alias("rolling_ic"),
        F.avg("ic").over(ever).alias("cumulative_ic"),
    )


def ic_trend(daily: DataFrame, by=(FACTOR,)) -> DataFrame:
    """Least-squares line through the IC series over its day index, with a verdict."""
    i = F.row_number().over(Window.partitionBy(*by).orderBy(DATE)) - 1
    fit = (
        daily.where(c("ic").isNotNull())
        .withColumn("_i", i.cast("double"))
        .groupBy(*by)
        .agg(
            F.coalesce(F.regr_slope("ic", "_i"), F.lit(0.0)).alias("_b"),
            F.coalesce(F.regr_r2("ic", "_i"), F.lit(0.0)).alias("_r2"),
            F.count("ic").alias("n_days"),
        )
    )
    enough = c("n_days") >= 10
    yearly = c("_b") * 252
    verdict = (
        F.when(~enough, "insufficient_data")
        .when(F.abs(yearly) < 0.005, "stable")
        .when(yearly < 0, "decaying")
        .otherwise("improving")
    )
    zero = F.lit(0.0)
    return fit.select(
        *by,
        F.when(enough, F.round(c("_b"), 6)).otherwise(zero).alias("slope"),
        F.when(enough, F.round(yearly, 4)).otherwise(zero).alias("slope_per_year"),
        F.when(enough, F.round("_r2", 4)).otherwise(zero).alias("r_squared"),
        "n_days",
        verdict.alias("verdict"),
    )
