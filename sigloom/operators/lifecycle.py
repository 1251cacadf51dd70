"""Directions, health transitions, promotion and registry decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..columns import DATE, FACTOR, VALUE
from ..functions.scalar import stable_factor_id
from .ic import daily_ic
from .panel import beside, by_calendar

c = F.col

WATCH_IC, WATCH_DAYS, RETIRE_DAYS, RECOVER_IC = 0.005, 5, 5, 0.01
WATCH_SCORE, RECOVER_SCORE = 0.45, 0.65
PROMOTE_COUNT, MAX_PROMOTED = 3, 30
HORIZON_WEIGHTS = {7: 0.5, 14: 0.3, 30: 0.2}


def weighted_ic(columns: dict[int, str] | None = None) -> Column:
    cols = columns or {h: f"ic_{h}d" for h in HORIZON_WEIGHTS}
    out = F.lit(0.0)
    for h, name in cols.items():
        out = out + HORIZON_WEIGHTS[h] * F.coalesce(c(name), F.lit(0.0))
    return out


def resolve_direction(stored: Column) -> Column:
    """Sign of the horizon-weighted ic; else the stored direction; else long."""
    w, kept = weighted_ic(), F.lower(stored)
    return (
        F.when(F.abs(w) > 1e-12, F.when(w < 0, "short").otherwise("long"))
        .when(kept.isin("long", "short"), kept)
        .otherwise("long")
    )


def repair_directions(registry: DataFrame) -> DataFrame:
    """Stored directions that are unknown or contradict the weighted ic are set from it."""
    w, d = weighted_ic(), c("direction")
    wrong = d.isNull() | ~d.isin("long", "short") | ((d == "long") & (w < 0)) | ((d == "short") & (w > 0))
    return registry.withColumn("direction", F.when(wrong, F.when(w < 0, "short").otherwise("long")).otherwise(d))


def oriented(value: Column, direction: Column) -> Column:
    """Values whose high end is the favoured one."""
    return F.when(F.lower(direction) == "short", -value).otherwise(value)


def orient(df: DataFrame, directions: DataFrame) -> DataFrame:
    """Flip short factors; ``directions`` has one row per factor."""
    flagged = df.join(F.broadcast(directions.select(FACTOR, "direction")), FACTOR, "left")
    return flagged.withColumn(VALUE, oriented(c(VALUE), c("direction"))).drop("direction")


def under_watch(registry: DataFrame) -> DataFrame:
    """Factors whose health is checked: promoted and on the watchlist."""
    return registry.where(c("status").isin("promoted", "watchlist"))


def recent_ic(df: DataFrame, target: str = "fwd_5", dates: int = 20, min_rows: int = 100, width=None) -> DataFrame:
    """Mean ic of each factor's own last dates that have pairs; 0 where too few rows."""
    pairs = df.where(c(VALUE).isNotNull() & c(target).isNotNull())
    latest = Window.partitionBy(FACTOR).orderBy(F.desc(DATE))
    days = pairs.groupBy(FACTOR, DATE).agg(F.count(F.lit(1)).alias("_n"))
    days = days.withColumn("_back", F.row_number().over(latest)).where(c("_back") <= dates)
    rows = days.groupBy(FACTOR).agg(F.sum("_n").alias("_rows"))
    recent = pairs.join(by_calendar(days.select(FACTOR, DATE)), [FACTOR, DATE], "left_semi")
    ic = daily_ic(recent, target, width=width).groupBy(FACTOR).agg(F.avg("ic").alias("_ic"))
    return rows.join(ic, FACTOR, "left").select(
        FACTOR, F.when(c("_rows") >= min_rows, F.coalesce("_ic", F.lit(0.0))).otherwise(0.0).alias("rolling_ic_20d")
    )


def recent_of(daily: DataFrame, dates: int = 20, min_rows: int = 100, at_least: int = 10) -> DataFrame:
    """``recent_ic`` out of a whole ic series (``daily_ic`` with at_least=1 and undefined="keep"), so that rows are ranked once for both."""
    latest = Window.partitionBy(FACTOR).orderBy(F.desc(DATE))
    days = daily.withColumn("_back", F.row_number().over(latest)).where(c("_back") <= dates)
    mean = F.coalesce(F.avg(F.when(c("n_stocks") >= at_least, c("ic"))), F.lit(0.0))
    return days.groupBy(FACTOR).agg(F.when(F.sum("n_stocks") >= min_rows, mean).otherwise(0.0).alias("rolling_ic_20d"))


def usable_ic(daily: DataFrame, at_least: int = 10) -> DataFrame:
    """Of a whole ic series the dates that ``daily_ic`` keeps."""
    return daily.where((c("n_stocks") >= at_least) & c("ic").isNotNull())


def watched_signals(df: DataFrame, watched: DataFrame) -> DataFrame:
    """Rows of the factors in ``watched`` (one row each), turned the way they are held.

    The factor list goes to every task: joined by key, each factor's rows
    would meet in one task and stay there for all that follows.
    """
    return orient(df.join(F.broadcast(watched.select(FACTOR)), FACTOR, "left_semi"), watched)


def whole_ic(days: DataFrame) -> DataFrame:
    """``daily_ic`` with at_least=1 and undefined="keep" out of daily scores whose ``min_ic`` is 1."""
    return days.where(c("n_stocks") > 0).select(FACTOR, DATE, "ic", "n_stocks")


def facing_ic(daily: DataFrame, watched: DataFrame) -> DataFrame:
    """The ic series of ``watched_signals`` out of that of the signals as they are: values turned around turn the sign."""
    turned = F.when(c("direction") == "short", -c("ic")).otherwise(c("ic"))
    return daily.join(F.broadcast(watched.select(FACTOR, "direction")), FACTOR).withColumn("ic", turned).drop("direction")


def next_state(status: Column, count: Column, ic: Column, score: Column, change: Column) -> tuple[Column, Column]:
    """Status and watch count after one check."""
    promoted, watched = status == "promoted", status == "watchlist"
    unhealthy = (ic < WATCH_IC) | (score < WATCH_SCORE) | change
    recovered = (ic >= RECOVER_IC) & (score >= RECOVER_SCORE) & ~change
    after = (
        F.when(promoted & unhealthy & (count + 1 >= WATCH_DAYS), "watchlist")
        .when(watched & recovered, "promoted")
        .when(watched & (count + 1 >= WATCH_DAYS + RETIRE_DAYS), "retired")
        .otherwise(status)
    )
    next_count = (
        F.when((promoted & ~unhealthy) | (watched & recovered), 0)
        .when(promoted | watched, count + 1)
        .otherwise(count)
    )
    return after, next_count


def health_transition(df: DataFrame) -> DataFrame:
    """Next status and watch count from rolling_ic_20d, health_score and regime_change."""
    status = c("status")
    after, next_count = next_state(
        status, F.coalesce("health_watch_count", F.lit(0)), c("rolling_ic_20d"), c("health_score"), c("regime_change")
    )
    return df.withColumns(
        {
            "status_after": after,
            "watch_count_after": next_count,
            "retire_reason_after": F.when((after == "retired") & (status != "retired"), "IC decay"),
        }
    )


def health_path(states: DataFrame, checks: DataFrame) -> DataFrame:
    """Every check of a span of days in order: (factor, as_of, rolling_ic_20d, status_before, status_after, watch_count_after).

    ``states``: factor, status, health_watch_count before the span. ``checks``:
    factor, as_of, rolling_ic_20d, health_score, regime_change. A factor's
    checks are bounded by the calendar and folded in one row, so a missed week
    is caught up in one job and equals day-by-day runs. A retired factor is
    not checked any more.
    """
    check = F.struct("as_of", "rolling_ic_20d", "health_score", "regime_change")
    series = checks.groupBy(FACTOR).agg(F.array_sort(F.collect_list(check)).alias("_checks"))
    kind = checks.schema["as_of"].dataType.simpleString()
    entry = f"struct<as_of:{kind},rolling_ic_20d:double,status_before:string,status_after:string,watch_count_after:int>"
    start = F.struct(
        c("status").alias("status"), F.coalesce("health_watch_count", F.lit(0)).cast("int").alias("n"),
        F.array().cast(f"array<{entry}>").alias("log"),
    )

    def fold(at: Column, x: Column) -> Column:
        after, n = next_state(at["status"], at["n"], x["rolling_ic_20d"], x["health_score"], x["regime_change"])
        line = F.struct(
            x["as_of"].alias("as_of"), x["rolling_ic_20d"].alias("rolling_ic_20d"), at["status"].alias("status_before"),
            after.alias("status_after"), n.cast("int").alias("watch_count_after"),
        )
        checked = at["status"].isin("promoted", "watchlist")
        log = F.when(checked, F.concat(at["log"], F.array(line))).otherwise(at["log"])
        return F.struct(after.alias("status"), n.cast("int").alias("n"), log.alias("log"))

    folded = F.aggregate("_checks", start, fold, lambda at: at["log"])
    return states.select(FACTOR, "status", "health_watch_count").join(series, FACTOR).select(FACTOR, F.inline(folded))


def health_log(transitions: DataFrame, as_of: Column) -> DataFrame:
    return transitions.select(
        as_of.alias("date"), FACTOR, "rolling_ic_20d", c("status").alias("status_before"), "status_after"
    )


def applied_transitions(registry: DataFrame, transitions: DataFrame, now: Column) -> DataFrame:
    """Registry with the checked factors' new status, counts and time stamps."""
    t = transitions.select(
        FACTOR, c("status_after"), c("watch_count_after"), c("rolling_ic_20d").alias("_ic"), "retire_reason_after"
    )
    checked = c("status_after").isNotNull()
    to = lambda s: checked & (c("status_after") == s) & (c("status") != s)
    changed = {
        "watchlist_at": F.when(to("watchlist"), now).otherwise(c("watchlist_at")),
        "retired_at": F.when(to("retired"), now).otherwise(c("retired_at")),
        "retire_reason": F.coalesce("retire_reason_after", "retire_reason"),
        "last_health_check": F.when(checked, now).otherwise(c("last_health_check")),
        "rolling_ic_20d": F.when(checked, c("_ic")).otherwise(c("rolling_ic_20d")),
        "health_watch_count": F.when(checked, c("watch_count_after")).otherwise(c("health_watch_count")).cast("int"),
        "status": F.when(checked, c("status_after")).otherwise(c("status")),
    }
    return registry.join(t, FACTOR, "left").select(
        *[changed[x].alias(x) if x in changed else c(x) for x in registry.columns]
    )


def promotion_plan(
    candidates: DataFrame, registry: DataFrame, promote: int = PROMOTE_COUNT, limit: int = MAX_PROMOTED
) -> DataFrame:
    """What happens to each candidate (ranked by ``rank``): refresh, promote, repromote or wait.

    Candidates and registry are factor lists, small next to any panel.
    """
    known = registry.select("formula", c(FACTOR).alias("existing_id"), c("status").alias("existing_status"))
    active = registry.agg(F.count_if(c("status") == "promoted").alias("_active"))
    joined = beside(candidates.join(known, "formula", "left"), active)
    is_active = F.coalesce(c("existing_status") == "promoted", F.lit(False))
    turn = F.row_number().over(Window.partitionBy(is_active).orderBy("rank"))
    slots = F.least(F.lit(promote), F.greatest(F.lit(0), F.lit(limit) - c("_active")))
    action = (
        F.when(is_active, "refresh")
        .when(c("_turn") > slots, "wait")
        .when(c("existing_id").isNotNull(), "repromote")
        .otherwise("promote")
    )
    return joined.withColumn("_turn", turn).withColumn("action", action).drop("_turn", "_active")


def promoted_registry(registry: DataFrame, plan: DataFrame, market: str, now: Column) -> DataFrame:
    """Registry after the plan: refreshed metrics, revived and new factors."""
    metrics = [x for x in plan.columns if x in registry.columns and x not in ("formula", FACTOR, "market", "status")]
    p = plan.select(
        "formula", c("action"), c(FACTOR).alias("_new_id"), *[c(m).alias(f"_new_{m}") for m in metrics]
    ).where(c("action") != "wait")
    hit, up = c("action").isNotNull(), c("action").isin("promote", "repromote")
    set_to = {m: F.when(hit, c(f"_new_{m}")).otherwise(c(m)) for m in metrics}
    none = F.lit(None)
    if "discovered_at" in registry.columns:
        set_to["discovered_at"] = F.coalesce("discovered_at", F.when(c("action") == "promote", now))
    set_to |= {
        FACTOR: F.coalesce(FACTOR, "_new_id"),
        "market": F.coalesce(c("market"), F.lit(market)),
        "status": F.when(up, F.lit("promoted")).otherwise(c("status")),
        "promoted_at": F.when(up, now).otherwise(c("promoted_at")),
        "watchlist_at": F.when(~up | up.isNull(), c("watchlist_at")),
        "retired_at": F.when(~up | up.isNull(), c("retired_at")),
        "retire_reason": F.when(up, none).otherwise(c("retire_reason")),
        "health_watch_count": F.when(up, F.lit(0)).otherwise(c("health_watch_count")),
    }
    types = dict(registry.dtypes)
    return registry.join(p, "formula", "full").select(
        *[(set_to[x] if x in set_to else c(x)).cast(types[x]).alias(x) for x in registry.columns]
    )


def multi_horizon(metrics: DataFrame, horizons=(7, 14, 30), mined: DataFrame | None = None) -> DataFrame:
    """Candidate rows from (factor, horizon, rows, ic_mean, ic_ir, monotonicity, long_short_pct).

    The direction is the sign of the weighted ic; where that is zero, of the
    ic in ``mined`` (factor, ic), if given. Horizons need 200 rows, factors two horizons; horizons where ic and
    monotonicity disagree add nothing to the composite score.
    """
    ok = metrics.where(c("rows") >= 200)
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in HORIZON_WEIGHTS.items() for x in kv]), c("horizon"))
    part = F.when(c("ic_mean") * c("monotonicity") >= 0, weight * F.abs("ic_mean") * F.abs("ic_ir")).otherwise(0.0)
    names = {"ic": "ic_mean", "ic_ir": "ic_ir", "mono": "monotonicity", "q5_q1": "long_short_pct"}
    wide = ok.groupBy(FACTOR).agg(
        *[
            F.coalesce(F.max(F.when(c("horizon") == h, c(src))), F.lit(0.0)).alias(f"{n}_{h}d")
            for n, src in names.items()
            for h in horizons
        ],
        F.sum(part).alias("composite_score"),
        F.count(F.lit(1)).alias("_h"),
    )
    wide = wide.where(c("_h") >= 2).drop("_h")
    lean = weighted_ic()
    if mined is not None:
        wide = wide.join(mined.select(FACTOR, c("ic").alias("_mined")), FACTOR, "left")
        lean = F.when(F.abs(lean) > 1e-12, lean).otherwise(F.coalesce("_mined", F.lit(0.0)))
    return wide.withColumn("direction", F.when(lean < 0, "short").otherwise("long")).drop("_mined")


def with_factor_id(df: DataFrame, market: str) -> DataFrame:
    return df.withColumn(FACTOR, stable_factor_id(F.lit(market), c("formula")))


def recent_registry(registry: DataFrame, today: Column, days: int = 7, n: int = 25) -> DataFrame:
    """Promoted factors and those retired or put on watch lately, best first."""
    since = F.date_sub(today, days)
    lately = (F.to_date("retired_at") >= since) | (F.to_date("watchlist_at") >= since)
    keep = (c("status") == "promoted") | (c("status").isin("retired", "watchlist") & F.coalesce(lately, F.lit(False)))
    return registry.where(keep).orderBy(c("composite_score").desc_nulls_last(), FACTOR).limit(n)


def promoted_on(registry: DataFrame, day: Column) -> DataFrame:
    return registry.where((c("status") == "promoted") & (F.to_date("promoted_at") == day)).orderBy(
        c("ic_ir_7d").desc_nulls_last(), FACTOR
    )


def registry_listing(registry: DataFrame, market: str) -> DataFrame:
    return registry.where(c("market") == market).orderBy(c("composite_score").desc_nulls_last(), FACTOR)


def registry_stats(registry: DataFrame) -> DataFrame:
    return registry.groupBy("market", "status").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.avg("ic_ir_7d"), F.lit(0.0)), 2).alias("avg_ir")
    )
