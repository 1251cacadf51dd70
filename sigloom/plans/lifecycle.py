"""The daily lifecycle of factors: mine, measure, penalise, weigh by feedback, check health, promote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..columns import BAR, DATE, FACTOR, SYMBOL, VALUE
from ..operators import dayscores as DS, feedback as FB, health as H, ic as IC, lifecycle as L, panel as P, quintiles as Q
from ..operators.longform import long_signals, wide_signals
from ..session import cut
from . import mining as M
from .evaluate import compute_factors

c = F.col
HORIZONS = (7, 14, 30)


def horizon_metrics(signals: DataFrame, horizons=HORIZONS, width: int | None = None) -> DataFrame:
    """ic, quantile spread and rows per (factor, horizon); ``signals`` carry ``fwd_<h>`` columns, unpivoted without a join."""
    by = [FACTOR, "horizon"]
    each = F.array(*[F.struct(F.lit(h).alias("horizon"), c(f"fwd_{h}").alias("fwd")) for h in horizons])
    long = signals.select(FACTOR, SYMBOL, DATE, VALUE, F.inline(each))
    return summed_horizons(cut(Q.daily_scores(Q.labelled(long, "fwd", by, width), "fwd", by)))


def horizon_days(wide: DataFrame, factors: list[str], horizons=HORIZONS, width: int | None = None) -> DataFrame:
    """Daily scores per (factor, horizon, date) of factors that are columns beside ``fwd_<h>``."""
    by = [FACTOR, "horizon"]
    if not DS.fits(wide, width):
        each = F.array(*[F.struct(F.lit(h).alias("horizon"), c(f"fwd_{h}").alias("fwd")) for h in horizons])
        long = long_signals(wide, factors, keep=[f"fwd_{h}" for h in horizons]).select(FACTOR, SYMBOL, DATE, VALUE, F.inline(each))
        return Q.daily_scores(Q.labelled(long, "fwd", by, width), "fwd", by)
    return of_horizons(DS.scores_of(wide, factors, [f"fwd_{h}" for h in horizons], width), horizons)


def of_horizons(days: DataFrame, horizons=HORIZONS, min_ic: int = 10) -> DataFrame:
    """``horizon_days`` out of daily scores of several targets (``DS.scores_of``)."""
    number = F.substring("target", 5, 9).cast("int")
    known = days.where(c("target").isin([f"fwd_{h}" for h in horizons]) & (c("n_stocks") > 0))
    return known.withColumns({"horizon": number, "ic": F.when(c("n_stocks") >= min_ic, c("ic"))}).drop("target")


def summed_horizons(days: DataFrame) -> DataFrame:
    """``horizon_metrics`` of stored daily scores."""
    by = [FACTOR, "horizon"]
    ic = IC.ic_summary(days.where(c("ic").isNotNull()), by)
    rows = days.groupBy(*by).agg(F.sum("n_stocks").alias("rows"))
    return rows.join(ic, by).join(Q.quintile_returns(days, by).drop("n_days"), by)


def daily_checks(
    facing: DataFrame, dates: DataFrame, target: str = "fwd_5", horizon: int = 5, days: int = 20, window: int = 20,
    min_rows: int = 100, width: int | None = None,
) -> DataFrame:
    """(factor, as_of, rolling_ic_20d, health_score, regime_change) on each of the last ``days`` dates.

    ``facing`` is turned the way each factor is held: its signals, or their
    whole ic series where that is at hand. A date's returns are
    known ``horizon`` dates later. The ic series is computed once; what was
    known on each day is a part of it, so the days cost rows of the series only.
    """
    recent = Window.partitionBy(FACTOR).orderBy(DATE).rowsBetween(-(window - 1), 0)
    mean = F.when(F.sum("n").over(recent) >= min_rows, F.coalesce(F.avg("ic").over(recent), F.lit(0.0))).otherwise(0.0)
    if "ic" in facing.columns:
        daily = facing
    else:
        daily = IC.daily_ic(facing, target, at_least=1, undefined="keep", width=width)
    series = daily.select(FACTOR, DATE, c("n_stocks").alias("n"), F.when(c("n_stocks") >= 10, c("ic")).alias("ic"))
    series = cut(series.withColumn("rolling", mean).join(P.by_calendar(dates), DATE))
    last = dates.agg(F.max("date_no")).first()[0] or 0
    first = max(last - days + 1, 0)
    # A date is known on every later day of the span.
    since = F.greatest(c("date_no") + horizon, F.lit(first))
    known = series.where(since <= last).select("*", F.explode(F.sequence(since, F.lit(last))).alias("as_no"))
    rolling = known.groupBy(FACTOR, "as_no").agg(F.max_by("rolling", "date_no").alias("rolling_ic_20d"))
    health = H.ic_health(known.select(FACTOR, "as_no", DATE, "ic"), by=(FACTOR, "as_no"))
    days_of = dates.select(c("date_no").alias("as_no"), c(DATE).alias("as_of"))
    out = rolling.join(health, [FACTOR, "as_no"], "left").join(days_of, "as_no")
    return out.select(
        FACTOR, "as_of", "rolling_ic_20d", F.coalesce("health_score", F.lit(0.5)).alias("health_score"),
        F.coalesce("regime_change", F.lit(False)).alias("regime_change"),
    )


def caught_up(signals: DataFrame, registry: DataFrame, dates: DataFrame, width: int | None = None, **how) -> DataFrame:
    """The health log of the last days of all factors under watch, as day-by-day runs would have written it.

    ``signals``: rows of the factors, or their whole ic series (``L.whole_ic``).
    """
    held = cut(L.under_watch(registry).select(FACTOR, "direction", "status", "health_watch_count"))
    facing = L.facing_ic(signals, held) if "ic" in signals.columns else L.watched_signals(signals, held)
    return L.health_path(held, daily_checks(facing, dates, width=width, **how))


def registry_columns(
    panel: DataFrame, formulas: dict[str, str], target: str = "fwd_5", member: str | None = None, width: int | None = None
) -> DataFrame:
    """(symbol, date, target) and a column per factor of the registry, from its formula (a factor list)."""
    return compute_factors(panel, formulas, keep=(target,), member=member, width=width).drop(BAR)


def last_rows(wide: DataFrame, factors: list[str]) -> DataFrame:
    """(factor, symbol, date, value) on the table's last date."""
    last = wide.agg(F.max(DATE)).first()[0]
    return long_signals(wide.where(c(DATE) == F.lit(last)), factors)


def candidate_table(
    panel: DataFrame, mined: DataFrame, grid: list[M.Candidate], promoted: DataFrame, feedback: DataFrame, as_of: Column,
    width: int | None = None, member: str | None = None,
) -> DataFrame:
    """The mined candidates with metrics at all horizons, penalties, feedback and their rank.

    ``promoted``: signals of the factors already promoted. ``feedback``: rows
    as ``sources.tables.feedback_source`` gives them.
    """
    names = {r[0] for r in mined.select(FACTOR).collect()}
    chosen = [x for x in grid if x.name in names]
    # One row per bar, a column per candidate: written once, ranked date by date for every horizon.
    wide = cut(M.signal_columns(panel, chosen, [f"fwd_{h}" for h in HORIZONS], width, member).where(c(DATE) <= as_of))
    columns = [x.name for x in chosen]
    days = cut(horizon_days(wide, columns, width=width))
    metrics = L.multi_horizon(summed_horizons(days), mined=mined)
    latest = cut(H.latest_snapshot(last_rows(wide, columns).unionByName(promoted.where(c(DATE) <= as_of), allowMissingColumns=True)))
    factors = [r[0] for r in latest.select(FACTOR).distinct().collect()]
    held = [r[0] for r in promoted.select(FACTOR).distinct().collect() if r[0] in factors]
    today = cut(wide_signals(latest.withColumn(DATE, as_of), factors))
    checks = H.candidate_checks(today, [x for x in factors if x in names], held)
    ic = DS.ic_of(days.where(c("horizon") == HORIZONS[0])).drop("horizon")
    health = H.ic_health(ic).select(FACTOR, "health_score", "regime_change").join(ic.groupBy(FACTOR).agg(F.count("ic").alias("n_ic")), FACTOR)
    scored = H.with_penalties(metrics.join(checks, FACTOR).join(health, FACTOR))
    weights = FB.feedback_weights(FB.recent_feedback(feedback, as_of))
    baskets = FB.baskets(latest.where(c(FACTOR).isin(*names)), scored)
    scored = FB.with_overlay(scored, FB.overlaps(baskets, weights))
    known = mined.select(FACTOR, "formula", "hypothesis", "stable_id", "ic", "ic_ir", "mono", "q5_q1")
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("rank_score"), FACTOR)  # one row per candidate
    return scored.join(known, FACTOR).withColumn("rank", F.row_number().over(order))


def daily_lifecycle(
    panel: DataFrame, grid: list[M.Candidate], registry: DataFrame, feedback: DataFrame, as_of: Column, now: Column, market: str,
    resamples: int = 100_000, width: int | None = None, member: str | None = None,
) -> dict[str, DataFrame]:
    """One day: candidates, health log and the registry after both.

    ``panel`` is numbered, has features and the forward returns ``fwd_5`` and
    those of HORIZONS; ``member`` names the flag of a universe (``panel.membership``).
    Health runs before promotion, so a retirement frees its slot the same day.
    """
    watched = cut(L.under_watch(registry).select(FACTOR, "formula", "direction", "status", "health_watch_count"))
    of = {r[FACTOR]: r for r in watched.collect()}  # a factor list
    held = cut(registry_columns(panel, {f: r["formula"] for f, r in of.items()}, member=member, width=width).where(c(DATE) <= as_of))
    facing = held.select(SYMBOL, DATE, "fwd_5", *[L.oriented(c(f), F.lit(r["direction"])).alias(f) for f, r in of.items()])
    watched = watched.drop("formula")
    daily = cut(DS.column_ic(facing, list(of), at_least=1, undefined="keep", width=width))
    health = H.ic_health(L.usable_ic(daily)).select(FACTOR, "health_score", "regime_change")
    moves = cut(L.health_transition(watched.join(L.recent_of(daily), FACTOR).join(health, FACTOR)))
    checked = cut(L.applied_transitions(registry, moves, now))
    mined = cut(M.mine(panel.where(c(DATE) <= as_of), grid, market, resamples=resamples, width=width, member=member))
    promoted = last_rows(held, list(of)).where(c(FACTOR).isin([f for f, r in of.items() if r["status"] == "promoted"]))
    candidates = cut(candidate_table(panel, mined, grid, promoted, feedback, as_of, width, member))
    plan = L.promotion_plan(candidates.drop(FACTOR).withColumnRenamed("stable_id", FACTOR), checked)
    return {
        "candidates": candidates,
        "health_log": L.health_log(moves, as_of),
        "plan": plan,
        "registry": L.promoted_registry(checked, plan, market, now),
    }
