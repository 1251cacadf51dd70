"""Rolling best-factor selection, rebalance schedule and pick lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..columns import DATE, FACTOR, SYMBOL, VALUE
from . import ranking
from .ic import daily_ic
from ..session import cut
from .panel import beside, by_calendar

c = F.col
MIN_NAMES = 30


def both_ends(df: DataFrame, n: int, by=(FACTOR, DATE)) -> DataFrame:
    """Top and bottom ``n`` rows by value, side "top"/"bot" and rank; symbol breaks ties.

    Spark prunes to n rows per group before shuffling, whatever the group's size.
    """
    valued = df.where(c(VALUE).isNotNull())
    top = ranking.top_rows(valued, list(by), [c(VALUE).desc(), c(SYMBOL)], n).withColumn("side", F.lit("top"))
    bot = ranking.top_rows(valued, list(by), [c(VALUE).asc(), c(SYMBOL)], n).withColumn("side", F.lit("bot"))
    return top.unionByName(bot)


def basket_returns(df: DataFrame, ret: str, n: int = 20, width: int | None = None) -> DataFrame:
    """Per factor and date: rows, usable names, mean return of the top and bottom basket (30 names needed).

    Groups that fit a task take one pass with both orders; larger ones are
    pruned to n rows per end before any group meets.
    """
    keys = [FACTOR, DATE]
    usable = c(VALUE).isNotNull() & c(ret).isNotNull()
    counts = [F.count(F.lit(1)).alias("rows"), F.count(F.when(usable, 1)).alias("names")]
    if ranking.fits_one_task(df, keys, width):
        v = F.when(usable, c(VALUE))
        group = Window.partitionBy(*keys)
        placed = df.withColumns(
            {
                "_top": F.row_number().over(group.orderBy(v.desc_nulls_last(), c(SYMBOL))),
                "_bot": F.row_number().over(group.orderBy(v.asc_nulls_last(), c(SYMBOL))),
            }
        )
        end = lambda x: F.avg(F.when(usable & (c(x) <= n), c(ret)))
        out = placed.groupBy(*keys).agg(*counts, end("_top").alias("top"), end("_bot").alias("bot"))
    else:
        ends = both_ends(df.where(c(ret).isNotNull()), n).groupBy(*keys).agg(
            F.avg(F.when(c("side") == "top", c(ret))).alias("top"), F.avg(F.when(c("side") == "bot", c(ret))).alias("bot")
        )
        out = df.groupBy(*keys).agg(*counts).join(ends, keys, "left")
    enough = c("names") >= MIN_NAMES
    return out.select(
        *keys, "rows", "names", F.when(enough, c("top")).alias("top"), F.when(enough, c("bot")).alias("bot")
    )


def chosen_rows(df: DataFrame, best: DataFrame) -> DataFrame:
    """Rows of the one chosen factor per date, with its side; ``best`` is calendar-sized."""
    return df.where(c(VALUE).isNotNull()).join(by_calendar(best), [FACTOR, DATE])


def trailing_sharpe(daily: DataFrame, dates: DataFrame, lookback: int = 40, lag: int = 0, min_days: int = 5) -> DataFrame:
    """For every factor and date: best side and its mean/deviation over the ``lookback`` dates before.

    ``lag`` moves the window back so that only realised returns enter.
    """
    w = Window.partitionBy(FACTOR).orderBy("date_no").rangeBetween(-(lookback + lag), -(lag + 1))
    numbered = daily.join(by_calendar(dates), DATE)
    sharpe = lambda s: F.avg(s).over(w) / (F.stddev_pop(s).over(w) + 1e-9)
    in_window = F.least(F.lit(lookback), F.greatest(c("date_no") - lag, F.lit(0)))
    enough = (F.count("top").over(w) >= min_days) & (F.sum("rows").over(w) >= in_window * 3)
    scored = numbered.select(
        FACTOR, DATE, "date_no", enough.alias("_ok"), sharpe("top").alias("_t"), sharpe("bot").alias("_b")
    ).where("_ok")
    return scored.select(
        FACTOR,
        DATE,
        "date_no",
        F.when(c("_t") > c("_b"), "top").otherwise("bot").alias("side"),
        F.greatest("_t", "_b").alias("sharpe"),
    )


def best_factor(scored: DataFrame) -> DataFrame:
    """One factor per date; among equals the first by id.  The input has factors × dates rows."""
    w = Window.partitionBy(DATE).orderBy(F.desc("sharpe"), FACTOR)
    return scored.withColumn("_rn", F.row_number().over(w)).where(c("_rn") == 1).drop("_rn")


def ic_exit_flag(df: DataFrame, dates: DataFrame, target: str = "fwd_1", window: int = 10, floor: float = -0.02, width=None) -> DataFrame:
    """Mean ic of the ``window`` dates before each date, and whether it fell below ``floor``."""
    daily = daily_ic(df, target, at_least=MIN_NAMES, width=width)
    frame = df.select(FACTOR, DATE).distinct().join(daily, [FACTOR, DATE], "left").join(by_calendar(dates), DATE)
    w = Window.partitionBy(FACTOR).orderBy("date_no").rangeBetween(-window, -1)
    recent = F.coalesce(F.avg("ic").over(w), F.lit(0.0))
    return frame.select(FACTOR, DATE, recent.alias("recent_ic"), (recent < floor).alias("should_exit"))


def rebalance_schedule(
    df: DataFrame, dates: DataFrame, ret: str, hold: int = 5, lookback: int = 40, n: int = 10, width: int | None = None,
    daily: DataFrame | None = None,
) -> DataFrame:
    """Holdings (rebalance_no, date_no, factor, side, symbol, rank) at every ``hold``-th date; ``daily``: ``basket_returns``, where at hand."""
    daily = basket_returns(df, ret, n, width) if daily is None else daily
    chosen = best_factor(trailing_sharpe(daily, dates, lookback, lag=hold))
    first = lookback + hold
    last = dates.agg((F.max("date_no")).alias("_last"))
    turns = cut(
        beside(chosen.where((c("date_no") >= first) & ((c("date_no") - first) % hold == 0)), last)
        .where(c("date_no") < c("_last"))
        .withColumn("rebalance_no", F.floor((c("date_no") - first) / hold))
        .select(FACTOR, DATE, "date_no", "side", "rebalance_no")
    )
    rows = chosen_rows(df, turns)
    crowd = rows.groupBy(DATE).agg(F.count(F.lit(1)).alias("_n")).where(c("_n") >= MIN_NAMES)
    order = [F.when(c("side") == "top", -c(VALUE)).otherwise(c(VALUE)), c(SYMBOL)]
    picks = ranking.top_rows(rows, [DATE], order, n).join(by_calendar(crowd), DATE, "left_semi")
    return picks.select("rebalance_no", "date_no", FACTOR, "side", SYMBOL, "rank")


def schedule_returns(
    holdings: DataFrame, bars: DataFrame, dates: DataFrame, benchmark: DataFrame, hold: int = 5, lookback: int = 40
) -> DataFrame:
    """Daily equal-weight next-bar return of the holdings beside the benchmark.

    ``bars``: symbol, date, ret_next.  ``benchmark``: date, benchmark.
    """
    first = lookback + hold
    last = F.max("date_no").over(Window.partitionBy(F.lit(0)))
    calendar = (
        dates.withColumn("_last", last)
        .where((c("date_no") >= first) & (c("date_no") < c("_last")))
        .withColumns(
            {"rebalance_no": F.floor((c("date_no") - first) / hold), "days_held": (c("date_no") - first) % hold}
        )
        .select(DATE, "rebalance_no", "days_held")
    )
    period = holdings.select("rebalance_no", FACTOR, "side").distinct()
    held = bars.join(by_calendar(calendar), DATE).join(
        F.broadcast(holdings.select("rebalance_no", SYMBOL)), ["rebalance_no", SYMBOL]  # n picks per period
    )
    rets = held.groupBy(DATE).agg(F.avg("ret_next").alias("_r"), F.count("ret_next").alias("_n"))
    zero = F.lit(0.0)
    return (
        calendar.join(period, "rebalance_no")
        .join(rets, DATE, "left")
        .join(benchmark, DATE, "left")
        .select(
            DATE,
            F.coalesce("_r", zero).alias("ret"),
            F.coalesce("benchmark", zero).alias("benchmark"),
            c(FACTOR),
            "side",
            F.coalesce("_n", F.lit(0)).alias("n_stocks"),
            "days_held",
        )
    )


def pick_scores(today: DataFrame, side: Column, n_picks: int, width: int | None = None) -> DataFrame:
    """Directed percent rank, kept for the best ``n_picks`` share and 0 otherwise.

    ``today``: one row per symbol with value and constant ``side``.
    """
    ranked = ranking.order_stats(today.where(c(VALUE).isNotNull()), [FACTOR], VALUE, "_v", width)
    up = ranking.percent_rank("_v")
    down = (c("_v_n") + 1 - ranking.average_rank("_v")) / c("_v_n")
    pct = F.when(side == "top", up).otherwise(down)
    kept = F.when(pct >= 1.0 - F.lit(float(n_picks)) / c("_v_n"), F.round(pct, 4)).otherwise(0.0)
    return ranked.withColumn("score", kept).drop("_v_below", "_v_upto", "_v_n")


def rank_weights(picks: DataFrame, by: list[str], place: str = "rank") -> DataFrame:
    """Linear weights n..1, normalised within ``by`` (a pick list)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return picks.withColumn("weight", (n + 1 - c(place)) * 2.0 / (n * (n + 1)))
