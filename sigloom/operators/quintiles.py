"""Quantile spreads, monotonicity and turnover of long signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..columns import DATE, FACTOR, SYMBOL, VALUE
from . import ranking
from .ic import pair_ranks, rank_correlation

c = F.col
GROUPS = 5


def labelled(
    df: DataFrame, target: str, by=(FACTOR,), width: int | None = None, keep_missing: bool = False
) -> DataFrame:
    """``pair_ranks`` rows with their quantile label ``q``."""
    return pair_ranks(df, target, by, width, keep_missing).withColumn("q", ranking.quantile_label("v", GROUPS))


def daily_scores(pairs: DataFrame, target: str, by=(FACTOR,), min_ic: int = 10) -> DataFrame:
    """Per (by, date) from ``labelled`` rows, in one aggregate: ic, quantile means, sizes.

    ``spread_ok`` marks dates with 25 names in which all five quantiles occur;
    quantile means are NULL elsewhere, ic is NULL below ``min_ic`` names.
    """
    means = [F.avg(F.when(c("q") == k, c(target))).alias(f"q{k}") for k in range(1, GROUPS + 1)]
    sizes = [F.count(F.when(c("q") == k, 1)).alias(f"n{k}") for k in range(1, GROUPS + 1)]
    daily = pairs.groupBy(*by, DATE).agg(
        rank_correlation().alias("ic"), F.count("v_below").alias("n_stocks"), *means, *sizes
    )
    all_bins = reduce(lambda a, b: a & b, [c(f"n{k}") > 0 for k in range(1, GROUPS + 1)])
    daily = daily.withColumn("spread_ok", (c("n_stocks") >= GROUPS * 5) & all_bins)
    return daily.select(
        *by,
        DATE,
        "n_stocks",
        F.when(c("n_stocks") >= min_ic, c("ic")).alias("ic"),
        "spread_ok",
        *[F.when(c("spread_ok"), c(f"q{k}")).alias(f"q{k}") for k in range(1, GROUPS + 1)],
        F.col(f"n{GROUPS}").alias("n_long"),
        F.col("n1").alias("n_short"),
    )


def monotonicity(means: list[Column]) -> Column:
    """Spearman correlation of 1..k with the k group means; constant means give 0."""
    k = len(means)
    mid = (k + 1) / 2.0
    ranks = []
    for i, m in enumerate(means):
        r = F.lit(1.0)
        for j, other in enumerate(means):
            if j != i:
                r = r + F.when(other < m, 1.0).when(other == m, 0.5).otherwise(0.0)
        ranks.append(r - mid)
    num = reduce(lambda a, b: a + b, [r * (i + 1 - mid) for i, r in enumerate(ranks)])
    den = reduce(lambda a, b: a + b, [r * r for r in ranks])
    span = sum((i + 1 - mid) ** 2 for i in range(k))
    return F.coalesce(F.try_divide(num, F.sqrt(den * span)), F.lit(0.0))


def quintile_returns(scores: DataFrame, by=(FACTOR,)) -> DataFrame:
    """Mean of daily quantile means in percent, long-short spread, monotonicity, days."""
    qs = [f"q{k}" for k in range(1, GROUPS + 1)]
    agg = scores.groupBy(*by).agg(
        *[F.coalesce(F.avg(q), F.lit(0.0)).alias(q) for q in qs],
        F.count(F.when(c("spread_ok"), 1)).alias("n_days"),
    )
    return agg.select(
        *by,
        *[F.round(c(q) * 100, 3).alias(q) for q in qs],
        F.round((c(qs[-1]) - c(qs[0])) * 100, 3).alias("long_short_pct"),
        F.round(monotonicity([c(q) for q in qs]), 3).alias("monotonicity"),
        "n_days",
    )


def kept_members(members: DataFrame, sides: list[str], by=(FACTOR,)) -> DataFrame:
    """How many names of each date were on the same side at their previous appearance.

    ``members`` has boolean side columns.  Each symbol looks back along its own
    history (bounded by the calendar), so dates are never joined with each other;
    the result is small: one row per (by, date, previous date).
    """
    own = Window.partitionBy(*by, SYMBOL).orderBy(DATE)
    seen = members.withColumns(
        {"prev_date": F.lag(DATE).over(own)} | {f"_was_{s}": F.lag(s).over(own) for s in sides}
    )
    return (
        seen.where(c("prev_date").isNotNull())
        .groupBy(*by, DATE, "prev_date")
        .agg(*[F.count(F.when(c(s) & c(f"_was_{s}"), 1)).alias(f"{s}_kept") for s in sides])
    )


def date_chain(days: DataFrame, ok: str, by=(FACTOR,)) -> DataFrame:
    """Usable dates of each series; ``prev_date`` only where the date before was usable too.

    ``days`` has one row per date of the series, usable or not.
    """
    order = Window.partitionBy(*by).orderBy(DATE)
    before = F.when(F.lag(ok).over(order), F.lag(DATE).over(order))
    return days.withColumn("prev_date", before).where(c(ok))


def scored_days(df: DataFrame, target: str = "fwd_5", by=(FACTOR,), width: int | None = None) -> DataFrame:
    """Every date of the series: ic, quantile means and, on usable dates, ls_return and turnover.

    A skipped date breaks the turnover chain: the date after it has no turnover.
    Rows are shuffled once by (by, date); the members of both ends once more by
    symbol.  Everything joined is one row per date.
    """
    by = list(by)
    pairs = labelled(df, target, by, width, keep_missing=True)
    scores = daily_scores(pairs, target, by)
    ends = pairs.where(c("q").isin(1, GROUPS)).select(
        *by, SYMBOL, DATE, (c("q") == GROUPS).alias("long"), (c("q") == 1).alias("short")
    )
    kept = kept_members(ends, ["long", "short"], by)
    order = Window.partitionBy(*by).orderBy(DATE)
    before = F.when(c("spread_ok") & F.lag("spread_ok").over(order), F.lag(DATE).over(order))
    away = lambda side: 1.0 - F.coalesce(f"{side}_kept", F.lit(0)) / c(f"n_{side}")
    return (
        scores.withColumn("prev_date", before)
        .join(kept, [*by, DATE, "prev_date"], "left")
        .withColumn("ls_return", c(f"q{GROUPS}") - c("q1"))
        .withColumn("turnover", F.when(c("prev_date").isNotNull(), (away("long") + away("short")) / 2.0))
        .drop("long_kept", "short_kept", "prev_date")
    )


def long_short(df: DataFrame, target: str = "fwd_5", by=(FACTOR,), width: int | None = None) -> DataFrame:
    """Usable dates with ls_return, turnover of both ends, ic and quantile means."""
    return scored_days(df, target, by, width).where(c("spread_ok"))


def top_turnover(df: DataFrame, share: float = 0.2, by=(FACTOR,), width: int | None = None) -> DataFrame:
    """Daily turnover of the top ``share`` by value: dates under 10 names break the chain."""
    by = list(by)
    valid = df.where(c(VALUE).isNotNull()).select(*by, SYMBOL, DATE, VALUE)
    placed = ranking.positions(valid, [*by, DATE], [c(VALUE).desc(), c(SYMBOL)], "_pos", "_n", width)
    size = F.greatest(F.floor(c("_n") * share), F.lit(1))
    top = placed.where(c("_pos") <= size)
    days = top.groupBy(*by, DATE).agg(F.max("_n").alias("_n")).withColumns({"n_top": size, "enough": c("_n") >= 10})
    members = top.where(c("_n") >= 10).select(*by, SYMBOL, DATE, F.lit(True).alias("top"))
    kept = kept_members(members, ["top"], by)
    return (
        date_chain(days, "enough", by)
        .where(c("prev_date").isNotNull())
        .join(kept, [*by, DATE, "prev_date"], "left")
        .select(*by, DATE, (1.0 - F.coalesce("top_kept", F.lit(0)) / c("n_top")).alias("turnover"))
    )


def turnover_summary(daily: DataFrame, by=(FACTOR,)) -> DataFrame:
    agg = daily.groupBy(*by).agg(F.avg("turnover").alias("_t"), F.count("turnover").alias("n_days"))
    return agg.select(
        *by, F.round("_t", 4).alias("avg_daily"), F.round(c("_t") * 21, 4).alias("avg_monthly"), "n_days"
    )
