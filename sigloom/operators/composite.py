"""Combining factors: weighted sum and quantile voting."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..columns import DATE, FACTOR, SYMBOL, VALUE
from . import dayscores as DS, moments as MO, quintiles as Q, ranking
from ..session import cut
from .panel import beside, by_calendar, trade_dates

c = F.col
#: Eigenvalues of a correlation matrix up to this are taken for rounding.
NO_VARIANCE = 1e-10


def ir_weights(registry: DataFrame, ir: str = "ic_ir_7d", when_missing: float = 1.0) -> DataFrame:
    """Normalised weights max(abs(ir), 0.01) per factor."""
    raw = F.greatest(F.coalesce(F.abs(ir), F.lit(when_missing)), F.lit(0.01))
    total = F.sum("_w").over(Window.partitionBy(F.lit(0)))
    return registry.select(FACTOR, raw.alias("_w")).withColumn("weight", c("_w") / total).drop("_w")


def saved_weights(weights: DataFrame, promoted: DataFrame, market: str) -> DataFrame:
    """Latest saved weights, normalised, only if every promoted factor has a positive one."""
    mine = weights.where(c("market") == market)
    latest = mine.agg(F.max("as_of").alias("as_of"))
    known = (
        mine.join(F.broadcast(latest), "as_of")
        .where(c("weight") > 0)
        .join(promoted.select(FACTOR), FACTOR, "left_semi")
    )
    counts = promoted.agg(F.count(F.lit(1)).alias("_need"))
    everything = Window.partitionBy(F.lit(0))
    counted = known.select(FACTOR, "weight").withColumns(
        {"_have": F.count(F.lit(1)).over(everything), "_sum": F.sum("weight").over(everything)}
    )
    return (
        beside(counted, counts)
        .where(c("_have") == c("_need"))
        .select(FACTOR, (c("weight") / c("_sum")).alias("weight"))
    )


def weighted_composite(df: DataFrame, weights: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Σ weight·value per (symbol, date), missing as 0: a union of factors, no outer joins.

    ``keep`` are columns equal on all rows of a (symbol, date).
    """
    weighted = df.join(F.broadcast(weights), FACTOR)
    return weighted.groupBy(SYMBOL, DATE).agg(
        F.sum(F.coalesce(c(VALUE), F.lit(0.0)) * c("weight")).alias(VALUE), *[F.max(k).alias(k) for k in keep]
    )


def weighted_columns(ranks: DataFrame, weights: dict[str, float], keep: tuple[str, ...] = ()) -> DataFrame:
    """``weighted_composite`` of factors that are columns of one row per (symbol, date)."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c(f), F.lit(0.0)) * F.lit(w) for f, w in weights.items()])
    return ranks.select(SYMBOL, DATE, total.alias(VALUE), *keep)


# --- voting ----------------------------------------------------------------

def end_means(df: DataFrame, target: str, width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Labels of every (factor, date) with 25 names and five quantiles, and its Q1/Q5 mean returns.

    Labels use values alone; returns are averaged over those that exist.
    """
    keys = [FACTOR, DATE]
    valued = df.where(c(VALUE).isNotNull())
    lab = ranking.order_stats(valued, keys, VALUE, "v", width).withColumn("q", ranking.quantile_label("v"))
    daily = lab.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("q").alias("_bins"),
        F.avg(F.when(c("q") == 1, c(target))).alias("q1"),
        F.avg(F.when(c("q") == 5, c(target))).alias("q5"),
    )
    daily = daily.where((c("n") >= 25) & (c("_bins") == 5)).select(*keys, "q1", "q5")
    return lab.select(FACTOR, SYMBOL, DATE, VALUE, "q"), daily


def voting_sides(
    daily: DataFrame, dates: DataFrame, lookback: int = 120, min_history: int = 20
) -> DataFrame:
    """Per factor and date the better end (1 or 5) over the ``lookback`` dates before."""
    before = Window.partitionBy(FACTOR).orderBy("date_no").rangeBetween(-lookback, -1)
    numbered = daily.join(by_calendar(dates), DATE)
    known = (F.count("q1").over(before) >= min_history) & (F.count("q5").over(before) >= min_history)
    better = known & (F.avg("q1").over(before) > F.avg("q5").over(before))
    return numbered.select(FACTOR, DATE, F.when(better, 1).otherwise(5).alias("best"))


def votes(labels: DataFrame, sides: DataFrame) -> DataFrame:
    """(best - worst) / votes per (symbol, date)."""
    cast = labels.join(sides, [FACTOR, DATE])
    mark = F.when(c("q") == c("best"), 1.0).when(c("q") == 6 - c("best"), -1.0).otherwise(0.0)
    return cast.groupBy(SYMBOL, DATE).agg(F.avg(mark).alias(VALUE))


def _inverse_form(flat, k: int):
    """From a flat k-by-k correlation matrix: the matrix M whose z'Mz is the squared distance.

    It is the inverse; only directions without variance are damped, as damping all of them would change the order of near distances.
    """
    m = np.asarray(flat, dtype=float).reshape(k, k)
    if not np.isfinite(m).all():
        return None
    lam, vec = np.linalg.eigh(m)
    if lam[0] > NO_VARIANCE:
        return list(np.linalg.inv(m).ravel())
    lam = np.where(lam > NO_VARIANCE, lam, (np.sqrt(np.clip(lam, 0.0, None)) + 1e-6) ** 2)
    return list(((vec / lam) @ vec.T).ravel())


def _whitening(flat: Column, k: int) -> Column:
    @F.pandas_udf("array<double>")
    def each(cov: pd.Series) -> pd.Series:
        return pd.Series([_inverse_form(x, k) for x in cov])

    return each(flat)


def distance_outliers(
    labels: DataFrame, daily: DataFrame, factors: list[str], min_names: int = 100, width: int | None = None
) -> DataFrame:
    """(symbol, date) beyond the 80th percentile of the Mahalanobis distance among the day's factors.

    Covariances are merged as matrices into one row per date; only those k-by-k
    matrices meet numpy. The distance is a form over two arrays of the row, so
    the plan's size grows with k, not with its square.
    """
    k = len(factors)
    # Absent factors of a date (no usable quantiles that day) drop out by counting as zero throughout.
    present = daily.groupBy(DATE).agg(F.collect_set(FACTOR).alias("_on"))
    values = labels.groupBy(SYMBOL, DATE).agg(F.map_from_entries(F.collect_set(F.struct(FACTOR, VALUE))).alias("_of"))
    filled = F.transform(F.lit(factors), lambda f: F.when(F.array_contains("_on", f), F.try_element_at("_of", f)).otherwise(0.0))
    rows = values.join(present, DATE).select(SYMBOL, DATE, filled.alias("x"))
    rows = rows.where(F.forall("x", lambda v: v.isNotNull()))
    measured = measured_distances(rows, k, min_names).where(c("distance").isNotNull())
    ranked = ranking.order_stats(measured, [DATE], "distance", "d", width)
    return ranked.where(c("d_below") > F.floor((c("d_n") - 1) * 4 / 5)).select(SYMBOL, DATE, "distance")


def measured_distances(rows: DataFrame, k: int, min_names: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(symbol, date, keep..., distance) of rows whose ``x`` holds k numbers; missing where one is, and on dates with under ``min_names`` whole rows."""
    whole = F.forall("x", lambda v: v.isNotNull())
    stats = MO.grouped_moments(rows.where(whole), c("x"), k, DATE).where(c("n") >= min_names)
    sd = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.sqrt(F.greatest(F.get("cov", i * (k + 1)), F.lit(0.0))))
    stats = stats.select(DATE, "mean", "cov", sd.alias("sd"))
    # A constant column counts as uncorrelated.
    cell = lambda v, i: F.coalesce(F.try_divide(v, F.get("sd", F.floor(i / k).cast("int")) * F.get("sd", i % k)), F.lit(0.0))
    stats = stats.select(DATE, "mean", "sd", _whitening(F.transform("cov", cell), k).alias("_w")).where(c("_w").isNotNull())
    z = F.zip_with(F.zip_with("x", "mean", lambda x, m: x - m), "sd", lambda x, s: x / (s + 1e-12))
    add = lambda a, b: a + b
    # z'w is one array; its product with z the squared distance.
    row = lambda i: F.aggregate(F.zip_with("_z", F.slice("_w", i * k + 1, F.lit(k)), lambda x, w: x * w), F.lit(0.0), add)
    form = F.aggregate(F.transform("_z", lambda x, i: x * row(i)), F.lit(0.0), add)
    measured = rows.join(by_calendar(stats), DATE, "left").select(SYMBOL, DATE, *keep, F.when(whole, z).alias("_z"), "_w")
    # Rounded, so that distances that are equal but for the order of summing tie.
    return measured.select(SYMBOL, DATE, *keep, F.round(F.sqrt(F.when(c("_z").isNotNull() & c("_w").isNotNull(), F.greatest(form, F.lit(0.0)))), 9).alias("distance"))


def voting_columns(
    ranks: DataFrame, factors: list[str], target: str = "fwd_5", lookback: int = 120, min_history: int = 20, min_names: int = 100,
    width: int | None = None, keep: tuple[str, ...] = (),
) -> DataFrame:
    """``voting_composite`` of factors that are columns of one row per (symbol, date), of which ``keep`` are passed on.

    ``ranks`` holds percent ranks and is read several times. Labels follow from a rank alone where no values tie; ties are
    counted, so labels are made where a date's names meet. What is known per factor and date is one row per DATE and goes
    to every task; a bar is never joined with itself.
    """
    k = len(factors)
    labels = DS.quantile_columns(ranks, factors, width)
    each = [
        F.struct(
            F.lit(f).alias(FACTOR),
            F.count(f).alias("n"),
            sum((F.max(F.when(c(f"_q_{f}") == i, 1).otherwise(0)) for i in range(1, Q.GROUPS + 1)), F.lit(0)).alias("_bins"),
            F.avg(F.when(c(f"_q_{f}") == 1, c(target))).alias("q1"),
            F.avg(F.when(c(f"_q_{f}") == 5, c(target))).alias("q5"),
        )
        for f in factors
    ]
    per_day = labels.groupBy(DATE).agg(F.array(*each).alias("_e")).select(DATE, F.inline("_e"))
    daily = cut(per_day.where((c("n") >= 25) & (c("_bins") == 5)).select(FACTOR, DATE, "q1", "q5"))
    sides = voting_sides(daily, trade_dates(ranks), lookback, min_history)
    at = [F.max(F.when(c(FACTOR) == f, c("best"))) for f in factors]
    sides = cut(sides.groupBy(DATE).agg(F.array(*at).alias("_best")))
    known = labels.join(by_calendar(sides), DATE, "left")
    marks, filled = [], []
    for i, f in enumerate(factors):
        q, best = c(f"_q_{f}"), F.get("_best", F.lit(i))
        mark = F.when(q == best, 1.0).when(q == 6 - best, -1.0).otherwise(0.0)
        marks.append(F.when(q.isNotNull() & best.isNotNull(), mark))
        filled.append(F.when(best.isNotNull(), c(f)).otherwise(0.0))
    votes_ = [F.when(m.isNotNull(), 1).otherwise(0) for m in marks]
    n, total = reduce(lambda a, b: a + b, votes_), reduce(lambda a, b: a + b, [F.coalesce(m, F.lit(0.0)) for m in marks])
    valued = F.greatest(*[F.when(c(f).isNotNull(), 1).otherwise(0) for f in factors]) == 1
    bars = cut(
        known.where(c("_best").isNotNull() & valued).select(
            SYMBOL, DATE, *keep, F.when(n > 0, total / n).alias("_vote"), F.array(*filled).alias("_x")
        )
    )
    far = measured_distances(bars.withColumnRenamed("_x", "x"), k, min_names, keep=(*keep, "_vote"))
    ranked = ranking.order_stats(far, [DATE], "distance", "d", width)
    half = F.when(c("d_below") > F.floor((c("d_n") - 1) * 4 / 5), 0.5).otherwise(1.0)
    return ranked.where(c("_vote").isNotNull()).select(SYMBOL, DATE, *keep, (c("_vote") * half).alias(VALUE))


def voting_composite(
    df: DataFrame,
    factors: list[str],
    target: str = "fwd_5",
    start: str | None = None,
    lookback: int = 120,
    min_history: int = 20,
    min_names: int = 100,
    width: int | None = None,
) -> DataFrame:
    """Quantile votes per (symbol, date), halved for outliers."""
    labels, daily = end_means(df, target, width)
    if start is not None:
        since = c(DATE) >= F.lit(start).cast("date")
        labels, daily, df = labels.where(since), daily.where(since), df.where(since)
    sides = voting_sides(daily, trade_dates(df), lookback, min_history)
    voted = votes(labels, sides)
    far = distance_outliers(labels, daily, factors, min_names, width).select(SYMBOL, DATE, F.lit(0.5).alias("_half"))
    return voted.join(far, [SYMBOL, DATE], "left").select(
        SYMBOL, DATE, (c(VALUE) * F.coalesce("_half", F.lit(1.0))).alias(VALUE)
    )


def best_ends(df: DataFrame, history: DataFrame, target: str = "fwd_5", min_history: int = 20, width=None) -> DataFrame:
    """Per factor the better end on the given dates of realised history; 5 when history is short."""
    pairs = Q.labelled(df.join(by_calendar(history), DATE, "left_semi"), target, width=width)
    days = Q.daily_scores(pairs, target).where(c("spread_ok"))
    agg = days.groupBy(FACTOR).agg(F.count(F.lit(1)).alias("_n"), F.avg("q1").alias("_1"), F.avg("q5").alias("_5"))
    return df.select(FACTOR).distinct().join(agg, FACTOR, "left").select(
        FACTOR, F.when((c("_n") >= min_history) & (c("_1") > c("_5")), 1).otherwise(5).alias("best_quintile")
    )


def history_dates(dates: DataFrame, as_of: Column, lookback: int = 120, holdout: int = 5) -> DataFrame:
    """The ``lookback`` dates ending ``holdout`` before ``as_of``, whose returns are known by then."""
    at = F.max(F.when(c(DATE) == as_of, c("date_no"))).over(Window.partitionBy(F.lit(0)))
    end = F.greatest(F.lit(0), at - holdout)
    return dates.withColumn("_end", end).where(
        (c("date_no") < c("_end")) & (c("date_no") >= c("_end") - lookback)
    ).select(DATE)
