"""Reports over many factors: stock indicators, promoted factors, method comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..columns import DATE, FACTOR, SYMBOL, VALUE
from ..operators import composite as CO, dayscores as DS, diagnostics as D, health as H, ic as IC, indicators as I, panel as P
from ..operators import quintiles as Q, walkforward as WF
from ..operators.longform import long_signals
from ..session import cut

c = F.col

REPORTED = ["rsi_14", "bb_position", "ma20_dist", "reversion_score", "volume_ratio", "squeeze_ratio", "ret_5d"]


def indicator_signals(panel: DataFrame, horizon: int = 5) -> DataFrame:
    """The seven stock indicators in long form with regime and forward return."""
    target = f"fwd_{horizon}"
    table = I.feature_table(panel.withColumn(target, P.forward_return(horizon)), keep=(target,))
    return long_signals(table, REPORTED, keep=["regime", target])


def factor_report(panel: DataFrame, horizon: int = 5, min_rows: int = 100, width: int | None = None) -> DataFrame:
    """One row per indicator: ic, quintile spread, turnover, trend and a status."""
    target = f"fwd_{horizon}"
    table = I.feature_table(panel.withColumn(target, P.forward_return(horizon)), keep=(target,))
    table = cut(table.select(SYMBOL, DATE, target, *REPORTED))
    signals = long_signals(table, REPORTED, keep=[target]).where(c(VALUE).isNotNull() & c(target).isNotNull())
    rows = signals.groupBy(FACTOR).agg(F.count(F.lit(1)).alias("n_rows")).where(c("n_rows") >= min_rows)
    if DS.fits(table, width):
        days = cut(DS.scores_of(table, REPORTED, target, width))
    else:
        days = Q.daily_scores(Q.labelled(signals, target, width=width), target)
    ic = days.where(c("ic").isNotNull()).select(FACTOR, DATE, "ic")
    turnover = Q.turnover_summary(Q.top_turnover(signals.select(FACTOR, SYMBOL, DATE, VALUE), width=width))
    trend = IC.ic_trend(ic).select(FACTOR, "slope_per_year", "verdict")
    out = (
        rows.join(IC.ic_summary(ic), FACTOR)
        .join(Q.quintile_returns(days).select(FACTOR, "long_short_pct", "monotonicity"), FACTOR)
        .join(turnover.select(FACTOR, "avg_daily"), FACTOR)
        .join(trend, FACTOR)
    )
    good_ic, good_ir = F.abs("ic_mean") > 0.02, F.abs("ic_ir") > 0.3
    some = good_ic | good_ir | (F.abs("monotonicity") > 0.7)
    return out.withColumn("status", F.when(good_ic & good_ir, "pass").when(some, "partial").otherwise("fail"))


def regime_report(panel: DataFrame, horizon: int = 5, width: int | None = None) -> DataFrame:
    return IC.ic_by_regime(indicator_signals(panel, horizon), f"fwd_{horizon}", width=width)


def regime_columns(wide: DataFrame, factors: list[str], target: str, width: int | None = None) -> DataFrame:
    """``ic.ic_by_regime`` of factors that are columns beside ``regime``; the names of one regime are ranked date by date."""
    long = long_signals(wide, factors, keep=["regime", target])
    own = lambda k: DS.column_ic(wide.where(c("regime") == k), factors, target, width=width).withColumn("regime", F.lit(k))
    daily = reduce(lambda a, b: a.unionByName(b), [own(k) for k in IC.REGIMES])
    return IC.ic_by_regime(long, target, width=width, daily=daily)


def market_diagnostics(df: DataFrame, target: str = "fwd_5", min_days: int = 80, width: int | None = None) -> DataFrame:
    """Signal diagnosis of every factor with 80 days of ic over at least 30 names."""
    return diagnosed_days(IC.daily_ic(df, target, at_least=30, width=width), min_days)


def column_diagnostics(
    wide: DataFrame, factors: list[str], target: str = "fwd_5", min_days: int = 80, width: int | None = None
) -> DataFrame:
    """``market_diagnostics`` of factors that are columns of one row per (symbol, date)."""
    if not DS.fits(wide, width):
        return market_diagnostics(long_signals(wide, factors, keep=[target]), target, min_days, width)
    days = DS.scores_of(wide, factors, target, width, min_ic=30)
    return diagnosed_days(days.where(c("ic").isNotNull()).select(FACTOR, DATE, "ic", "n_stocks"), min_days)


def diagnosed_days(daily: DataFrame, min_days: int) -> DataFrame:
    daily = cut(daily)  # a row per factor and date, read once by each diagnosis
    long_enough = daily.groupBy(FACTOR).count().where(c("count") >= min_days).select(FACTOR)
    return D.full_diagnosis(daily.join(F.broadcast(long_enough), FACTOR, "left_semi"))


def redundancy_report(wide: DataFrame, factors: list[str]) -> DataFrame:
    """Each factor against all the others on one date (wide: a row per symbol)."""
    return H.collinearity_of_all(wide, factors)


def compare_methods(
    df: DataFrame,
    factors: list[str],
    weights: DataFrame,
    folds: DataFrame,
    target: str = "fwd_5",
    cost: float = 0.003,
    top_k: int = 5,
    lookback: int = 120,
    width: int | None = None,
) -> DataFrame:
    """Walk-forward averages of the best single factors, the weighted and the voting composite."""
    returns = df.groupBy(SYMBOL, DATE).agg(F.max(target).alias(target))
    voted = CO.voting_composite(df, factors, target, lookback=lookback, width=width).join(returns, [SYMBOL, DATE])
    weighted = CO.weighted_composite(df, weights, keep=(target,))
    cols = [FACTOR, SYMBOL, DATE, VALUE, target]
    everything = (
        df.select(*cols)
        .unionByName(weighted.withColumn(FACTOR, F.lit("*weighted")).select(*cols))
        .unionByName(voted.withColumn(FACTOR, F.lit("*voting")).select(*cols))
    )
    return side_by_side(WF.walk_forward(WF.fold_metrics(everything, folds, target, cost, width=width)), top_k)


def compare_columns(
    ranks: DataFrame, factors: list[str], weights: dict[str, float], folds: DataFrame, target: str = "fwd_5", cost: float = 0.003,
    top_k: int = 5, lookback: int = 120, width: int | None = None,
) -> DataFrame:
    """``compare_methods`` of factors that are columns of one row per (symbol, date); ``ranks`` is read several times."""
    voted = CO.voting_columns(ranks, factors, target, lookback, width=width, keep=(target,))
    weighted = CO.weighted_columns(ranks, weights, keep=(target,))
    cols = [FACTOR, SYMBOL, DATE, VALUE, target]
    everything = (
        long_signals(ranks, factors, keep=[target]).select(*cols)
        .unionByName(weighted.withColumn(FACTOR, F.lit("*weighted")).select(*cols))
        .unionByName(voted.withColumn(FACTOR, F.lit("*voting")).select(*cols))
    )
    return side_by_side(WF.walk_forward(WF.fold_metrics(everything, folds, target, cost, width=width)), top_k)


def side_by_side(scored: DataFrame, top_k: int) -> DataFrame:
    """A row per method out of the averages of all factors, "*weighted" and "*voting"."""
    names = ["avg_ic", "avg_ic_ir", "avg_sharpe", "avg_turnover", "avg_monotonicity"]
    digits = [4, 3, 3, 4, 3]
    scored = cut(scored)
    own = ~c(FACTOR).startswith("*")
    best = scored.where(own).orderBy(F.desc("avg_sharpe"), FACTOR).limit(top_k)
    single = best.agg(
        *[F.round(F.avg(n), d).alias(n) for n, d in zip(names, digits)],
        F.round(F.avg("n_folds"), 0).cast("long").alias("n_folds"),
    ).select(F.lit("single_top").alias("method"), *names, "n_folds")
    combined = scored.where(~own).select(
        F.when(c(FACTOR) == "*voting", "voting").otherwise("weighted").alias("method"), *names, "n_folds"
    )
    return single.unionByName(combined)
