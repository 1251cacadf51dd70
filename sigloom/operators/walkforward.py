"""Anchored walk-forward evaluation and the out-of-sample check."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..columns import DATE, FACTOR, SYMBOL
from ..functions.scalar import ratio, rounded
from . import dayscores as DS, quintiles as Q
from .gates import MARKET_GATES
from .ic import daily_ic, information_ratio
from .panel import by_calendar, in_sample_dates

c = F.col


def fold_dates(
    dates: DataFrame,
    oos_start: str,
    n_folds: int = 2,
    warmup: int = 120,
    min_test: int = 60,
    embargo: int = 5,
) -> DataFrame:
    """Date → test fold (0-based), from the indexed dates of ``panel.trade_dates``.

    In-sample dates after the warm-up are cut into ``n_folds`` chunks of at
    least ``min_test`` dates; a chunk under half of that is no fold.
    """
    everything = Window.partitionBy(F.lit(0))
    dated = in_sample_dates(dates, oos_start, embargo).withColumn("_n", F.count(F.lit(1)).over(everything))
    left = c("_n") - warmup
    chunk = F.greatest(F.lit(min_test), F.floor(left / n_folds))
    cut = (
        dated.where((left >= min_test) & (c("date_no") >= warmup))
        .withColumn("fold", F.floor((c("date_no") - warmup) / chunk).cast("int"))
        .where(c("fold") < n_folds)
    )
    size = F.count(F.lit(1)).over(Window.partitionBy("fold"))
    return cut.withColumn("_size", size).where(c("_size") >= min_test // 2).select(DATE, "fold")


def fold_metrics(
    df: DataFrame,
    folds: DataFrame,
    target: str = "fwd_5",
    cost: float = 0.003,
    horizon: int = 5,
    by=(FACTOR,),
    width: int | None = None,
) -> DataFrame:
    """Metrics per (by, fold): every factor and fold in the same pass."""
    test = df.join(by_calendar(folds), DATE)
    return metrics_of_folds(Q.scored_days(test, target, [*by, "fold"], width), cost, horizon, by)


def fold_columns(
    wide: DataFrame, factors: list[str], folds: DataFrame, target: str = "fwd_5", cost: float = 0.003, horizon: int = 5,
    rows: DataFrame | None = None,
) -> DataFrame:
    """``fold_metrics`` of factors that are columns of one row per (symbol, date); a date must fit a task (``DS.fits``).

    ``rows``: ``DS.date_rows`` of the factors and the target, where at hand. A name looks back along its own dates once for all
    factors, and what it was there decides whether it stayed.
    """
    rows = DS.date_rows(wide, [c(f) for f in factors], [target]) if rows is None else rows
    k, keys = len(factors), [FACTOR, "fold"]
    order = Window.partitionBy("fold").orderBy(DATE)
    chain = folds.withColumn("prev_date", F.lag(DATE).over(order))  # a row per DATE
    days = DS.day_scores(wide, [c(f) for f in factors], [(i,) for i in range(k)], target, every=True, rows=rows)
    days = days.join(by_calendar(chain), DATE)
    own = Window.partitionBy(SYMBOL).orderBy(DATE)
    marks = DS.side_marks(rows, k).withColumns({"_was": F.lag("marks").over(own), "_on": F.lag(DATE).over(own)})
    marks = marks.join(by_calendar(chain), DATE).where(c("_on") == c("prev_date"))
    kept = lambda i, q: F.count_if((F.get("marks", F.lit(i)) == q) & (F.get("_was", F.lit(i)) == q))
    each = [F.struct(F.lit(i).alias(FACTOR), kept(i, Q.GROUPS).alias("long_kept"), kept(i, 1).alias("short_kept")) for i in range(k)]
    stayed = marks.groupBy(DATE).agg(F.array(*each).alias("_e")).select(DATE, F.inline("_e"))
    series = Window.partitionBy(*keys).orderBy(DATE)
    chained = c("spread_ok") & F.lag("spread_ok").over(series)
    away = lambda side: 1.0 - F.coalesce(f"{side}_kept", F.lit(0)) / c(f"n_{side}")
    scored = days.withColumn("_chained", chained).join(stayed, [FACTOR, DATE], "left").withColumns(
        {
            "ls_return": c(f"q{Q.GROUPS}") - c("q1"),
            "turnover": F.when(c("_chained"), (away("long") + away("short")) / 2.0),
            FACTOR: F.get(F.array(*[F.lit(f) for f in factors]), c(FACTOR)),
        }
    )
    return metrics_of_folds(scored, cost, horizon)


def metrics_of_folds(days: DataFrame, cost: float, horizon: int, by=(FACTOR,)) -> DataFrame:
    """``fold_metrics`` out of the scored days of each fold."""
    keys = [*by, "fold"]
    qs = [f"q{k}" for k in range(1, Q.GROUPS + 1)]
    agg = days.groupBy(*keys).agg(
        F.avg("ic").alias("_ic"),
        F.stddev_samp("ic").alias("_ic_sd"),
        F.avg("ls_return").alias("_ls"),
        F.stddev_pop("ls_return").alias("_ls_sd"),
        F.coalesce(F.avg("turnover"), F.lit(0.0)).alias("_to"),
        *[F.coalesce(F.avg(q), F.lit(0.0)).alias(q) for q in qs],
        F.min(DATE).alias("test_start"),
        F.max(DATE).alias("test_end"),
        F.count(F.lit(1)).alias("n_test_days"),
    )
    sd = c("_ls_sd") / horizon
    sharpe = F.when(sd > 1e-10, ratio(c("_ls") / horizon - c("_to") * cost, sd) * F.sqrt(F.lit(252.0))).otherwise(0.0)
    return (
        agg.where(c("_ic").isNotNull() & c("_ls").isNotNull()).select(
            *keys,
            "test_start",
            "test_end",
            F.round("_ic", 4).alias("ic"),
            F.round(information_ratio(c("_ic"), c("_ic_sd")), 3).alias("ic_ir"),
            F.round(sharpe, 3).alias("sharpe"),
            F.round("_to", 4).alias("turnover"),
            F.round(Q.monotonicity([c(q) for q in qs]), 3).alias("monotonicity"),
            "n_test_days",
        )
    )


def walk_forward(metrics: DataFrame, by=(FACTOR,)) -> DataFrame:
    """Averages of the (rounded) fold metrics."""
    names = {"ic": 4, "ic_ir": 3, "sharpe": 3, "turnover": 4, "monotonicity": 3}
    return metrics.groupBy(*by).agg(
        *[rounded(F.avg(m), d).alias(f"avg_{m}") for m, d in names.items()],
        F.count(F.lit(1)).alias("n_folds"),
    )


def oos_check(
    df: DataFrame, oos_start: str, market: str = "cn", target: str = "fwd_5", by=(FACTOR,), width: int | None = None
) -> DataFrame:
    """Pass or fail per factor on dates from ``oos_start``; no metric leaves this function."""
    held_out = df.where(c(DATE) >= F.lit(oos_start).cast("date"))
    stats = daily_ic(held_out, target, by, width=width).groupBy(*by).agg(
        F.avg("ic").alias("_m"), F.stddev_samp("ic").alias("_s")
    )
    passed = (F.abs("_m") >= MARKET_GATES[market]["ic"]) & (information_ratio(c("_m"), c("_s")) > 0)
    return (
        df.select(*by).distinct()
        .join(stats, list(by), "left")
        .select(*by, F.coalesce(passed, F.lit(False)).alias("oos_pass"))
    )
