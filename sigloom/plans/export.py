"""From signals to a day's scores, trade levels and pick list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..columns import DATE, FACTOR, SYMBOL, VALUE
from ..functions.formula import look_back
from ..operators import indicators as I, panel as P, portfolio as PF, quality as QL, ranking, selection as SE
from ..operators.longform import long_signals
from ..session import cut
from .evaluate import compute_factors

c = F.col


def _chosen(
    signals: DataFrame, dates: DataFrame, day, ret: str, lookback: int, n_picks: int, lag: int = 0, width: int | None = None
) -> DataFrame:
    """The best factor and side on ``day``: one row."""
    daily = cut(SE.basket_returns(signals, ret, n_picks, width))  # factors × dates rows
    return cut(SE.best_factor(SE.trailing_sharpe(daily, dates, lookback, lag)).where(c(DATE) == F.lit(day)))


def _day(dates: DataFrame, as_of: str):
    return dates.where(c(DATE) <= F.lit(as_of).cast("date")).agg(F.max(DATE)).first()[0]


def recent_panel(
    bars: DataFrame, formulas: dict[str, str], as_of: str, horizon: int = 5, lookback: int = 40, lag: int = 0, more: int = 15,
    width: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(panel, signals) that a report on ``as_of`` needs, and nothing older.

    The dates are the last ``lookback + lag`` before the report's and its own.
    How far back their values reach follows from the formulas (and ``more``
    bars for the trade levels); the scan is bounded by it. Signals have the
    values of ``formulas`` and ``fwd_<horizon>`` on those dates only, and are
    what a run over all history gives; they are written once, a row per name
    and date, as every step of a report reads them. ``width`` as for
    ``compute_factors``. ``bars`` are read several times.
    """
    days = bars.select(DATE).distinct().where(c(DATE) <= F.lit(as_of).cast("date")).orderBy(F.desc(DATE)).limit(lookback + lag + 1)
    bounds = days.agg(F.min(DATE).alias("first"), F.max(DATE).alias("last")).first()
    spans = [look_back(x) for x in formulas.values()]
    back = None if None in spans else max([more, *spans])
    near = P.bars_around(bars, str(bounds["first"]), str(bounds["last"]), back, horizon)
    panel = P.with_features(P.index_bars(P.positive_close(near))).withColumn(f"fwd_{horizon}", P.forward_return(horizon))
    wide = compute_factors(panel, formulas, keep=(f"fwd_{horizon}",), width=width)
    wide = cut(wide.where(c(DATE).between(bounds["first"], bounds["last"])))
    return panel, long_signals(wide, list(formulas), keep=[f"fwd_{horizon}"])


def export(
    panel: DataFrame, signals: DataFrame, as_of: str, market: str, ret: str = "fwd_5", lookback: int = 40,
    n_picks: int = 10, width: int | None = None, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Sink rows of one report date: the best recent factor's top share, with levels as JSON detail.

    The detail is rounded; ``keep`` passes on columns as they were before, of
    close, atr_14, sharpe and the signals' own.
    """
    dates = P.trade_dates(signals)
    day = _day(dates, as_of)
    best = _chosen(signals, dates, day, ret, lookback, n_picks, width=width)
    today = signals.where(c(DATE) == F.lit(day)).join(
        F.broadcast(best.select(FACTOR, "side", "sharpe")), FACTOR  # one row
    )
    scored = SE.pick_scores(today, c("side"), n_picks, width)
    levels = I.with_atr(panel).where(c(DATE) == F.lit(day)).select(SYMBOL, "close", "atr_14")
    priced = PF.trade_levels(
        scored.join(levels, SYMBOL, "left").withColumn("direction", F.when(c("score") > 0, "long").otherwise("short")), market
    )
    detail = {
        "method": F.lit("rolling_best"),
        "selected_factor": c(FACTOR),
        "selected_side": c("side"),
        "lookback_sharpe": F.round("sharpe", 4),
        "trade_date": F.lit(str(day)),
        "entry": c("entry"),
        "stop": c("stop"),
        "target": c("target"),
        "atr": c("atr"),
        "rr": c("rr"),
        "direction": F.when(c("entry").isNotNull(), c("direction")),
        "hold_days": F.when(c("entry").isNotNull(), F.lit(5)),
    }
    return PF.export_rows(priced, F.lit(as_of).cast("date"), detail, keep=keep)


def pick_list(
    signals: DataFrame, as_of: str, metadata: DataFrame, quality: DataFrame, ret: str = "fwd_5", lookback: int = 40,
    n_picks: int = 10, candidates: int | None = None, lag: int = 0, allowed: list[str] | None = None,
    width: int | None = None,
) -> DataFrame:
    """Candidates from the chosen end with reasons to reject, the accepted ones weighted by place."""
    dates = P.trade_dates(signals)
    day = _day(dates, as_of)
    best = _chosen(signals, dates, day, ret, lookback, n_picks, lag, width)
    wanted = candidates or max(n_picks * 5, 25)
    today = signals.where((c(DATE) == F.lit(day)) & c(VALUE).isNotNull()).join(
        F.broadcast(best.select(FACTOR, "side")), FACTOR
    )
    order = F.when(c("side") == "top", -c(VALUE)).otherwise(c(VALUE))
    picks = ranking.top_rows(today.withColumn("_o", order), [FACTOR], [c("_o"), c(SYMBOL)], wanted).drop("_o")
    judged = QL.accepted_picks(picks, metadata, quality, n_picks, [FACTOR], allowed)
    good = SE.rank_weights(judged.where(c("place").isNotNull()), [FACTOR], "place").select(SYMBOL, "weight")
    return judged.join(good, SYMBOL, "left")
