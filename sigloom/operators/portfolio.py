"""Trade levels, export rows, paper tracking, performance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..columns import DATE, SYMBOL
from ..functions import rolling as R
from ..functions.scalar import ratio, rounded, share_true
from .panel import by_calendar, neighbour_dates

c = F.col
STOP_FLOOR = 0.85


def trade_levels(df: DataFrame, market: str) -> DataFrame:
    """Entry, stop, target, reward/risk from close, atr_14 and direction; NULL without a usable range."""
    entry, atr = c("close"), c("atr_14")
    long = c("direction") == "long"
    stop = rounded(F.when(long, entry - atr * 2).otherwise(entry + atr * 2), 2)
    target = rounded(F.when(long, entry + atr * 3).otherwise(entry - atr * 3), 2)
    if market == "cn":
        low, high = rounded(entry * 0.90, 2), rounded(entry * 1.10, 2)
        stop = F.when(long, F.greatest(stop, low)).otherwise(F.least(stop, high))
        target = F.when(long, target).otherwise(F.least(target, high))
    ok = entry.isNotNull() & (atr > 0)
    df = df.withColumns({"stop": F.when(ok, stop), "target": F.when(ok, target)})
    risk = F.abs(entry - c("stop"))
    reward = F.when(risk > 0.01, ratio(F.abs(c("target") - entry), risk)).otherwise(0.0)
    return df.withColumns(
        {"entry": F.when(ok, rounded(entry, 2)), "atr": F.when(ok, rounded(atr, 2)), "rr": F.when(ok, rounded(reward, 2))}
    )


def watch_levels(df: DataFrame, market: str) -> DataFrame:
    """Stop and target of a pick list row; an unusable range counts as 3% of the close."""
    close = c("close")
    atr = F.when(c("atr_14") > 0, c("atr_14")).otherwise(close * 0.03)
    stop = rounded(close - atr * 2, 2)
    if market == "cn":
        stop = F.greatest(stop, rounded(close * 0.90, 2))
    else:
        stop = F.greatest(stop, rounded(close * STOP_FLOOR, 2), F.lit(0.01))
    return df.withColumns({"stop": stop, "target": rounded(close + atr * 3, 2), "atr_pct": atr / close})


def export_rows(
    scored: DataFrame, as_of: Column, method: dict[str, Column], module: str = "factor", metric: str = "composite",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Sink rows (symbol, as_of, module, metric, value, detail) with the detail as JSON text; ``keep`` are columns passed along unrounded."""
    detail = F.to_json(F.struct(*[v.alias(k) for k, v in method.items()]))
    return scored.select(
        SYMBOL,
        as_of.alias("as_of"),
        F.lit(module).alias("module"),
        F.lit(metric).alias("metric"),
        c("score").alias("value"),
        detail.alias("detail"),
        *keep,
    )


def next_returns(bars: DataFrame, close: str = "close") -> DataFrame:
    """Return to the next trading date of the whole market; NULL where the symbol has no bar then.

    A symbol looks ahead along its own bars, so prices are not joined with themselves.
    """
    own = Window.partitionBy(SYMBOL).orderBy(DATE)
    ahead = bars.select(
        SYMBOL, DATE, ratio(F.lead(close).over(own), c(close)).alias("_r"), F.lead(DATE).over(own).alias("_next")
    )
    steps = by_calendar(neighbour_dates(bars).select(DATE, "next_date"))
    return ahead.join(steps, DATE).select(
        SYMBOL, DATE, "next_date", F.when(c("_next") == c("next_date"), c("_r") - 1).alias("ret_1d")
    )


def pending_dates(picks: DataFrame, returns: DataFrame) -> DataFrame:
    """Pick dates that have no evaluated return yet."""
    return picks.select("as_of").distinct().join(returns.select("as_of"), "as_of", "left_anti")


def paper_picks(df: DataFrame, best: DataFrame, n: int = 10) -> DataFrame:
    """Per date, ``n`` long picks from the chosen end of the chosen factor and ``n`` short ones from the other."""
    from .selection import both_ends, chosen_rows

    rows = chosen_rows(df, best.select("factor_id", DATE, c("side").alias("_best")))
    ends = both_ends(rows, n, by=(DATE,))
    return ends.select(
        c(DATE).alias("as_of"),
        F.when(c("side") == c("_best"), "long").otherwise("short").alias("side"),
        "rank",
        SYMBOL,
        c("value").alias("composite_score"),
    )


def paper_returns(picks: DataFrame, next_ret: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Equal-weight next-date returns of both sides, excess over the benchmark, compounded.

    ``picks`` is 2·n rows per date; ``benchmark``: date, benchmark.
    """
    joined = picks.join(next_ret.withColumnRenamed(DATE, "as_of"), ["as_of", SYMBOL], "left")
    return followed_picks(joined, neighbour_dates(next_ret), benchmark)


def followed_picks(joined: DataFrame, neighbours: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``paper_returns`` of picks that carry ``ret_1d``, their return to the next date of ``neighbours`` (``panel.neighbour_dates``)."""
    side = lambda s: F.when(c("side") == s, c("ret_1d"))
    zero = F.lit(0.0)
    steps = neighbours.select(c(DATE).alias("as_of"), c("next_date").alias("eval_date"))
    daily = (
        joined.groupBy("as_of")
        .agg(
            F.coalesce(F.avg(side("long")), zero).alias("long_ret"),
            F.coalesce(F.avg(side("short")), zero).alias("short_ret"),
            F.count(side("long")).alias("n_long"),
            F.count(side("short")).alias("n_short"),
        )
        .join(steps, "as_of")
        .where(c("eval_date").isNotNull())
        .join(benchmark.select(c(DATE).alias("as_of"), "benchmark"), "as_of", "left")
        .withColumn("benchmark_ret", F.coalesce("benchmark", zero))
        .drop("benchmark")
        .withColumns({"ls_ret": c("long_ret") - c("short_ret"), "long_excess": c("long_ret") - c("benchmark_ret")})
    )
    run = Window.partitionBy(F.lit(0)).orderBy("as_of").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grow = lambda x: F.product(1.0 + c(x)).over(run) - 1.0
    return daily.withColumns(
        {"cum_long": grow("long_ret"), "cum_benchmark": grow("benchmark_ret"), "cum_excess": grow("long_excess")}
    )


def equity_curve(df: DataFrame, ret: str = "ret", date: str = DATE) -> DataFrame:
    """Compounded equity and drawdown along a dated return series (calendar-sized)."""
    run = Window.partitionBy(F.lit(0)).orderBy(date).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("equity", F.product(1.0 + c(ret)).over(run))
    return df.withColumn("drawdown", ratio(c("equity"), F.max("equity").over(run)) - 1.0)


def performance(df: DataFrame, ret: str = "ret", benchmark: str = "benchmark", date: str = DATE) -> DataFrame:
    """Annualised summary of a dated return series, one row."""
    curve = equity_curve(df, ret, date).withColumn("_x", c(ret) - c(benchmark))
    agg = curve.agg(
        (F.avg(ret) * 252).alias("ann_return"),
        (F.stddev_pop(ret) * F.sqrt(F.lit(252.0))).alias("volatility"),
        (F.avg(benchmark) * 252).alias("ann_benchmark"),
        (F.avg("_x") * 252).alias("ann_excess"),
        (F.stddev_pop("_x") * F.sqrt(F.lit(252.0))).alias("_xv"),
        share_true(c(ret) > 0).alias("win_rate"),
        share_true(c("_x") > 0).alias("win_vs_benchmark"),
        F.min("drawdown").alias("max_drawdown"),
        (F.max_by("equity", date) - 1.0).alias("cum_return"),
        F.count(F.lit(1)).alias("n_days"),
    )
    rated = lambda a, v: F.when(c(v) > 0, ratio(c(a), c(v))).otherwise(0.0)
    return agg.withColumns(
        {"sharpe": rated("ann_return", "volatility"), "info_ratio": rated("ann_excess", "_xv")}
    ).drop("_xv")


def monthly(df: DataFrame, ret: str = "ret", benchmark: str = "benchmark", date: str = DATE) -> DataFrame:
    agg = df.groupBy(F.to_date(F.date_trunc("month", date)).alias("month")).agg(
        F.sum(ret).alias("ret"), F.sum(benchmark).alias("benchmark")
    )
    return agg.withColumn("excess", c("ret") - c("benchmark"))


def factor_usage(df: DataFrame) -> DataFrame:
    total = F.sum("days").over(Window.partitionBy(F.lit(0)))
    counts = df.groupBy("factor_id").agg(F.count(F.lit(1)).alias("days"))
    return counts.withColumn("share", c("days") / total)


def basket_turnover(picks: DataFrame, date: str = "as_of", by: tuple[str, ...] = ()) -> DataFrame:
    """Turnover of successive pick sets (picks are few per date)."""
    from .quintiles import kept_members

    rows = picks.select(*by, c(date).alias(DATE), SYMBOL, F.lit(True).alias("held"))
    kept = kept_members(rows, ["held"], by)
    sizes = rows.groupBy(*by, DATE).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*(by or (F.lit(0),))).orderBy(DATE)
    chain = sizes.withColumn("prev_date", F.lag(DATE).over(order)).where(c("prev_date").isNotNull())
    return chain.join(kept, [*by, DATE, "prev_date"], "left").select(
        *by, c(DATE).alias(date), (1.0 - F.coalesce("held_kept", F.lit(0)) / c("_n")).alias("turnover")
    )


def equal_weight_benchmark(df: DataFrame, ret: str = "ret_next") -> DataFrame:
    return df.groupBy(DATE).agg(F.avg(ret).alias("benchmark"))


def with_next_return(df: DataFrame) -> DataFrame:
    """``ret_next`` to the symbol's next bar on a numbered panel."""
    return df.withColumn("ret_next", ratio(F.lead("close", 1).over(R.by_symbol()), c("close")) - 1)
