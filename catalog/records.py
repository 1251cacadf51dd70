"""Registry, lifecycle, feedback, experiment logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.columns import DATE, FACTOR, SYMBOL, VALUE
from sigloom.operators import dayscores as DS, feedback as FB, health as H, ic as IC, lifecycle as L, panel as P
from sigloom.plans import lifecycle as LP, mining as M
from sigloom.session import cut
from sigloom.sources import logs as LG, tables as ST

from . import testbed as B
from .registry import query, shaped
from .scoring import mined
from .checks import _CHANGE, _SCORE, daily, ep_sql
from .sql import PARTS, avg_rank, corr, day, part, qlabel, with_

c = F.col
NOW = "2001-06-01 00:00:00"
TODAY = "2001-06-01"


# --- registry built from the factors' own metrics --------------------------
FORWARD = tuple(f"fwd_{h}" for h in LP.HORIZONS)


def target_days(spark, sf):
    """Daily scores of all factors against the next five bars and FORWARD, stored: bars and windows are computed once, a date's names meet once."""
    wide, w = B.wide_inputs(spark, sf), B.width(spark, sf)
    if not DS.fits(wide, w):
        return None
    return cut(DS.scores_of(wide, B.FACTORS, ["fwd_5", *FORWARD], w, min_ic=1, every=True))


def series_of(days):
    return L.whole_ic(days.where(c("target") == "fwd_5"))


def horizon_metrics(spark, sf, wide=None, days=None):
    """A rank orders names as its input does, so inputs are scored as they are. ``wide``: ``B.stored_inputs`` with FORWARD; ``days``: ``target_days``, where at hand."""
    if days is not None:
        return LP.summed_horizons(LP.of_horizons(days))
    wide = B.wide_inputs(spark, sf) if wide is None else wide
    return LP.summed_horizons(cut(LP.horizon_days(wide, B.FACTORS, width=B.width(spark, sf))))


def multi_horizon(spark, sf, wide=None, days=None):
    return L.multi_horizon(horizon_metrics(spark, sf, wide, days))


_H = " UNION ALL ".join(
    f"SELECT factor_id, {h} AS horizon, date, symbol, value, fwd_{h} AS fwd FROM signals WHERE value IS NOT NULL AND fwd_{h} IS NOT NULL"
    for h in (7, 14, 30)
)
part("hpairs", ["signals"], _H)
part(
    "hranked",
    ["hpairs"],
    f"""SELECT *, {avg_rank('value', 'factor_id, horizon, date')} AS rv, {avg_rank('fwd', 'factor_id, horizon, date')} AS rf,
        count(*) OVER (PARTITION BY factor_id, horizon, date) AS n, {qlabel('value', 'factor_id, horizon, date')} AS q FROM hpairs""",
)
from .scoring import mono_sql  # noqa: E402

part(
    "hmetrics",
    ["hranked"],
    f"""SELECT factor_id, horizon, ic, ic_ir, mono, q5_q1 FROM (
        SELECT factor_id, horizon, round(avg(ic), 4) AS ic, round(avg(ic) / stddev_samp(ic), 3) AS ic_ir FROM (
          SELECT factor_id, horizon, date, {corr('rv', 'rf')} AS ic FROM hranked WHERE n >= 10 GROUP BY ALL) GROUP BY ALL)
        JOIN (SELECT factor_id, horizon, round({mono_sql()}, 3) AS mono, round((q5 - q1) * 100, 3) AS q5_q1 FROM (
          SELECT factor_id, horizon, {', '.join(f'avg(q{k}) AS q{k}' for k in range(1, 6))} FROM (
            SELECT factor_id, horizon, date, {', '.join(f'avg(fwd) FILTER (WHERE q = {k}) AS q{k}' for k in range(1, 6))} FROM hranked
            WHERE n >= 25 GROUP BY factor_id, horizon, date HAVING count(DISTINCT q) = 5) GROUP BY ALL)) USING (factor_id, horizon)""",
)
_PIVOT = ", ".join(
    f"max({m}) FILTER (WHERE horizon = {h}) AS {m}_{h}d" for m in ("ic", "ic_ir", "mono", "q5_q1") for h in (7, 14, 30)
)
part(
    "multi",
    ["hmetrics"],
    f"""SELECT *, CASE WHEN 0.5 * ic_7d + 0.3 * ic_14d + 0.2 * ic_30d < 0 THEN 'short' ELSE 'long' END AS direction FROM (
        SELECT factor_id, {_PIVOT}, sum(CASE WHEN ic * mono >= 0 THEN CASE horizon WHEN 7 THEN 0.5 WHEN 14 THEN 0.3 ELSE 0.2 END * abs(ic) * abs(ic_ir) ELSE 0 END)
        AS composite_score FROM hmetrics GROUP BY factor_id)""",
)


@query(
    "multi_horizon_metrics",
    with_("multi", "SELECT * EXCLUDE (composite_score), round(composite_score, 6) AS composite_score FROM multi"),
)
def multi_horizon_metrics(spark, sf):
    return shaped(multi_horizon(spark, sf))


def registry(spark, sf, wide=None, days=None):
    """A registry in the stored schema: statuses and stamps spread over the factors by name."""
    pos = F.ascii(F.substring(FACTOR, 1, 1)) + F.length(FACTOR)
    status = F.when(pos % 3 == 0, "promoted").when(pos % 3 == 1, "watchlist").otherwise("retired")
    df = multi_horizon(spark, sf, wide, days).withColumns(
        {
            "market": F.lit("us"),
            "name": F.upper(FACTOR),
            "formula": F.concat(F.lit("rank("), c(FACTOR), F.lit(")")),
            "direction": F.when(pos % 2 == 0, "long").otherwise("short"),
            "status": status,
            "promoted_at": F.lit("2001-05-01 10:00:00").cast("timestamp"),
            "watchlist_at": F.when(pos % 3 == 1, F.lit("2001-05-28 09:00:00").cast("timestamp")),
            "retired_at": F.when(pos % 3 == 2, F.lit("2001-05-10 09:00:00").cast("timestamp")),
            "health_watch_count": pos % 11,
        }
    )
    return ST.conformed(df, "factor_registry")


part(
    "registry",
    ["multi"],
    """SELECT factor_id, 'us' AS market, upper(factor_id) AS name, 'rank(' || factor_id || ')' AS formula, CASE WHEN p % 2 = 0 THEN 'long' ELSE 'short' END AS direction,
       CASE p % 3 WHEN 0 THEN 'promoted' WHEN 1 THEN 'watchlist' ELSE 'retired' END AS status, p % 11 AS health_watch_count, composite_score,
       ic_7d, ic_14d, ic_30d, ic_ir_7d, CASE p % 3 WHEN 1 THEN DATE '2001-05-28' END AS watchlist_at, CASE p % 3 WHEN 2 THEN DATE '2001-05-10' END AS retired_at
       FROM (SELECT *, ascii(factor_id) + length(factor_id) AS p FROM multi)""",
)
_WIC = "(0.5 * ic_7d + 0.3 * ic_14d + 0.2 * ic_30d)"


@query(
    "registry_table",
    with_(
        "registry",
        """SELECT factor_id, market, name, formula, direction, status, health_watch_count, round(composite_score, 6) AS composite_score, ic_7d, ic_ir_7d FROM registry""",
    ),
)
def registry_table(spark, sf):
    cols = ["factor_id", "market", "name", "formula", "direction", "status", "health_watch_count", "composite_score", "ic_7d", "ic_ir_7d"]
    return shaped(registry(spark, sf).select(*cols))


@query(
    "registry_listing",
    with_("registry", "SELECT name, status, round(composite_score, 6) AS composite_score FROM registry WHERE market = 'us'"),
)
def registry_listing(spark, sf):
    return shaped(L.registry_listing(registry(spark, sf), "us").select("name", "status", "composite_score"))


@query(
    "registry_stats",
    with_("registry", "SELECT market, status, count(*) AS n, round(avg(ic_ir_7d), 2) AS avg_ir FROM registry GROUP BY market, status"),
)
def registry_stats(spark, sf):
    return shaped(L.registry_stats(registry(spark, sf)))


@query(
    "resolve_direction",
    with_("registry", f"SELECT factor_id, CASE WHEN {_WIC} < 0 THEN 'short' WHEN {_WIC} > 0 THEN 'long' ELSE direction END AS resolved FROM registry"),
)
def resolve_direction(spark, sf):
    return registry(spark, sf).select(FACTOR, L.resolve_direction(c("direction")).alias("resolved"))


@query(
    "repair_directions",
    with_("registry", f"SELECT factor_id, CASE WHEN {_WIC} < 0 THEN 'short' ELSE 'long' END AS direction FROM registry"),
)
def repair_directions(spark, sf):
    return L.repair_directions(registry(spark, sf)).select(FACTOR, "direction")


@query(
    "orient_short_factors",
    with_(
        "signals registry",
        f"""SELECT factor_id, symbol, {day('date')}, round(CASE WHEN direction = 'short' THEN -value ELSE value END, 6) AS value
        FROM signals JOIN (SELECT factor_id, direction FROM registry) USING (factor_id)""",
    ).replace("signals AS (", "signals AS MATERIALIZED (", 1).replace("registry AS (", "registry AS MATERIALIZED (", 1),
)
def orient_short_factors(spark, sf):
    directions = cut(registry(spark, sf).select(FACTOR, "direction"))
    return shaped(L.orient(B.signals(spark, sf), directions).select(FACTOR, SYMBOL, DATE, VALUE))


@query(
    "recent_registry",
    with_(
        "registry",
        f"""SELECT factor_id, status FROM registry WHERE status = 'promoted' OR (status IN ('retired', 'watchlist')
        AND (retired_at >= DATE '{TODAY}' - 7 OR watchlist_at >= DATE '{TODAY}' - 7)) ORDER BY composite_score DESC NULLS LAST, factor_id LIMIT 25""",
    ),
)
def recent_registry(spark, sf):
    return L.recent_registry(registry(spark, sf), F.lit(TODAY).cast("date")).select(FACTOR, "status")


@query("promoted_on_day", with_("registry", "SELECT factor_id FROM registry WHERE status = 'promoted'"))
def promoted_on_day(spark, sf):
    return L.promoted_on(registry(spark, sf), F.lit("2001-05-01").cast("date")).select(FACTOR)


# --- health ----------------------------------------------------------------
# Health is judged on values turned the way the factor is held, and only while it is held or watched.
part("watched", ["registry"], "SELECT * FROM registry WHERE status IN ('promoted', 'watchlist')")
part(
    "facing_ic",
    ["ic", "watched"],
    "SELECT factor_id, date, CASE WHEN direction = 'short' THEN -ic ELSE ic END AS ic FROM ic JOIN watched USING (factor_id)",
)
part("facing_parts", ["facing_ic"], PARTS["ic_parts"][1].replace("FROM ic)", "FROM facing_ic)"))
part("facing_ep", ["facing_parts"], ep_sql("facing_parts", "factor_id, part"))
part("facing_health", ["facing_parts", "facing_ep"], PARTS["health"][1].replace("ic_parts", "facing_parts").replace("ic_ep", "facing_ep"))
part(
    "recent20",
    ["pairs", "watched"],
    f"""SELECT factor_id, CASE WHEN n >= 100 THEN coalesce(m, 0) ELSE 0 END AS rolling_ic_20d FROM (SELECT factor_id, count(*) AS n FROM p20 GROUP BY 1)
        LEFT JOIN (SELECT factor_id, avg(CASE WHEN direction = 'short' THEN -ic ELSE ic END) AS m FROM (SELECT factor_id, date, {corr('rv', 'rf')} AS ic FROM (
          SELECT factor_id, date, {avg_rank('value', 'factor_id, date')} AS rv, {avg_rank('fwd', 'factor_id, date')} AS rf FROM p20)
          GROUP BY factor_id, date HAVING count(*) >= 10) JOIN watched USING (factor_id) GROUP BY 1) USING (factor_id)""".replace(
        "p20", "(SELECT * FROM pairs WHERE factor_id IN (SELECT factor_id FROM watched) QUALIFY dense_rank() OVER (PARTITION BY factor_id ORDER BY date DESC) <= 20)"
    ),
)


def transitions(spark, sf, known=None, days=None):
    """Next states of the registry (``known``, where it is at hand already; so with ``target_days``)."""
    days = target_days(spark, sf) if days is None else days
    reg = L.under_watch(registry(spark, sf, days=days) if known is None else known)
    reg = cut(reg.select(FACTOR, "direction", "status", "health_watch_count"))
    if days is not None:
        daily = cut(L.facing_ic(series_of(days), reg))
    else:
        facing = L.watched_signals(B.signals(spark, sf), reg)
        daily = cut(IC.daily_ic(facing, at_least=1, undefined="keep", width=B.width(spark, sf)))
    recent = L.recent_of(daily)
    health = H.ic_health(L.usable_ic(daily)).select(FACTOR, "health_score", "regime_change")
    return cut(L.health_transition(reg.drop("direction").join(recent, FACTOR).join(health, FACTOR)))


part(
    "moves",
    ["watched", "recent20", "facing_health"],
    f"""SELECT *, CASE WHEN status = 'promoted' AND sick AND health_watch_count + 1 >= 5 THEN 'watchlist' WHEN status = 'watchlist' AND well THEN 'promoted'
        WHEN status = 'watchlist' AND health_watch_count + 1 >= 10 THEN 'retired' ELSE status END AS status_after,
        CASE WHEN (status = 'promoted' AND NOT sick) OR (status = 'watchlist' AND well) THEN 0 WHEN status IN ('promoted', 'watchlist') THEN health_watch_count + 1
        ELSE health_watch_count END AS watch_count_after FROM (
          SELECT r.factor_id, r.status, r.health_watch_count, x.rolling_ic_20d, {_SCORE} AS health_score, {_CHANGE} AS regime_change,
            x.rolling_ic_20d < 0.005 OR {_SCORE} < 0.45 OR {_CHANGE} AS sick, x.rolling_ic_20d >= 0.01 AND {_SCORE} >= 0.65 AND NOT {_CHANGE} AS well
          FROM watched r JOIN recent20 x USING (factor_id) JOIN facing_health h USING (factor_id))""",
)


@query(
    "health_transition",
    with_("moves", "SELECT factor_id, status, round(rolling_ic_20d, 6) AS rolling_ic_20d, health_score, regime_change, status_after, watch_count_after FROM moves"),
)
def health_transition(spark, sf):
    return shaped(transitions(spark, sf).drop("health_watch_count", "retire_reason_after"))


# --- health over a span of days --------------------------------------------
part("asof_days", ["daynos"], "SELECT date AS as_of, no AS as_no FROM daynos ORDER BY no DESC LIMIT 20")
part(
    "facing_asof",
    ["facing_ic", "daynos", "asof_days"],
    "SELECT factor_id || '|' || as_no AS factor_id, date, ic FROM facing_ic JOIN daynos USING (date) JOIN asof_days ON no <= as_no - 5",
)
part("asof_parts", ["facing_asof"], PARTS["ic_parts"][1].replace("FROM ic)", "FROM facing_asof)"))
part("asof_ep", ["asof_parts"], ep_sql("asof_parts", "factor_id, part"))
part("asof_health", ["asof_parts", "asof_ep"], PARTS["health"][1].replace("ic_parts", "asof_parts").replace("ic_ep", "asof_ep"))
part(
    "rolling20",
    ["pairs", "watched"],
    f"""SELECT factor_id, date, CASE WHEN sum(n) OVER w >= 100 THEN coalesce(avg(ic) OVER w, 0) ELSE 0 END AS rolling FROM (
        SELECT factor_id, date, count(*) AS n, CASE WHEN count(*) >= 10 THEN {corr('rv', 'rf')} * any_value(CASE WHEN direction = 'short' THEN -1 ELSE 1 END) END AS ic
        FROM (SELECT p.factor_id, p.date, w.direction, {avg_rank('p.value', 'p.factor_id, p.date')} AS rv, {avg_rank('p.fwd', 'p.factor_id, p.date')} AS rf
          FROM pairs p JOIN watched w USING (factor_id)) GROUP BY factor_id, date)
        WINDOW w AS (PARTITION BY factor_id ORDER BY date ROWS 19 PRECEDING)""",
)
part(
    "day_checks",
    ["rolling20", "daynos", "asof_days", "asof_health"],
    f"""SELECT r.*, {_SCORE} AS health_score, {_CHANGE} AS regime_change FROM (
        SELECT factor_id, as_no, any_value(as_of) AS as_of, arg_max(rolling, no) AS rolling_ic_20d FROM rolling20 JOIN daynos USING (date) JOIN asof_days ON no <= as_no - 5
        GROUP BY factor_id, as_no) r JOIN asof_health h ON h.factor_id = r.factor_id || '|' || as_no""",
)
part(
    "steps",
    ["day_checks"],
    """SELECT *, row_number() OVER (PARTITION BY factor_id ORDER BY as_no) AS step, rolling_ic_20d < 0.005 OR health_score < 0.45 OR regime_change AS sick,
       rolling_ic_20d >= 0.01 AND health_score >= 0.65 AND NOT regime_change AS well FROM day_checks""",
)


@query(
    "health_path",
    with_("watched steps", "").replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    + f""",
path AS (
  SELECT factor_id, 0::BIGINT AS step, NULL::DATE AS as_of, 0.0::DOUBLE AS ic, status AS before, status AS after, health_watch_count::BIGINT AS n FROM watched
  UNION ALL
  SELECT p.factor_id, s.step, s.as_of, s.rolling_ic_20d, p.after,
    CASE WHEN p.after = 'promoted' AND sick AND n + 1 >= 5 THEN 'watchlist' WHEN p.after = 'watchlist' AND well THEN 'promoted'
      WHEN p.after = 'watchlist' AND n + 1 >= 10 THEN 'retired' ELSE p.after END,
    CASE WHEN (p.after = 'promoted' AND NOT sick) OR (p.after = 'watchlist' AND well) THEN 0 ELSE n + 1 END
  FROM path p JOIN steps s ON s.factor_id = p.factor_id AND s.step = p.step + 1 WHERE p.after IN ('promoted', 'watchlist'))
SELECT factor_id, {day('as_of')}, round(ic, 6) AS rolling_ic_20d, before AS status_before, after AS status_after, n AS watch_count_after FROM path WHERE step > 0""",
)
def health_path(spark, sf):
    """Twenty days of checks folded in one job."""
    days = target_days(spark, sf)
    if days is None:
        dates = P.trade_dates(B.panel(spark, sf))
        return shaped(LP.caught_up(B.signals(spark, sf), registry(spark, sf), dates, width=B.width(spark, sf)))
    return shaped(LP.caught_up(series_of(days), registry(spark, sf, days=days), P.trade_dates(days)))


LIVE = {"live_a": "rank(-delta(close, 3))", "live_b": "rank(ts_mean(volume, 10))", "live_c": "rank(-ts_std(ret_1d, 20))", "live_d": "rank(ret_20d)"}


def live_registry(spark, sf):
    """A registry of formulas that can be evaluated."""
    rows = [(i, f, "us", "watchlist" if i == "live_d" else "promoted", "long", 3) for i, f in LIVE.items()]
    df = spark.createDataFrame(rows, f"{FACTOR} string, formula string, market string, status string, direction string, health_watch_count int")
    return ST.conformed(df, "factor_registry")


def live_panel(spark, sf):
    """Numbered bars are written once: the lifecycle makes values from them again and again."""
    return P.with_features(cut(B.panel(spark, sf, spread=True))).withColumns({f"fwd_{h}": P.forward_return(h) for h in (5, *LP.HORIZONS)})


@query("daily_lifecycle")
def daily_lifecycle(spark, sf):
    """One whole day over the grid's twenty-bar ranks of volume: the registry afterwards. Its steps have checked queries; the chain is tested."""
    grid = [x for x in M.factor_grid() if len(x.inners) == 1 and "volume" in x.formula and "20" in x.formula]
    day_ = F.lit("2001-06-01").cast("date")
    out = LP.daily_lifecycle(
        live_panel(spark, sf), grid, live_registry(spark, sf), ST.feedback_source(postmortem(spark, sf)), day_,
        F.lit(NOW).cast("timestamp"), "us", resamples=2000, width=B.width(spark, sf),
    )
    return shaped(out["registry"].select(FACTOR, "formula", "direction", "status", "composite_score", "health_watch_count"))


@query(
    "health_log",
    with_("moves", f"SELECT '{TODAY}' AS date, factor_id, round(rolling_ic_20d, 6) AS rolling_ic_20d, status AS status_before, status_after FROM moves"),
)
def health_log(spark, sf):
    return shaped(L.health_log(transitions(spark, sf), F.lit(TODAY).cast("date")))


@query(
    "applied_transitions",
    with_(
        "registry moves",
        """SELECT r.factor_id, coalesce(m.status_after, r.status) AS status, coalesce(m.watch_count_after, r.health_watch_count) AS health_watch_count,
        CASE WHEN m.status_after = 'retired' THEN 'IC decay' END AS retire_reason FROM registry r LEFT JOIN moves m USING (factor_id)""",
    ),
)
def applied_transitions(spark, sf):
    now = F.lit(NOW).cast("timestamp")
    reg = cut(registry(spark, sf))
    out = L.applied_transitions(reg, transitions(spark, sf, reg), now)
    return shaped(out.select(FACTOR, "status", "health_watch_count", "retire_reason"))


# --- promotion -------------------------------------------------------------
def candidates(spark, sf, wide=None):
    """Mined factors as today's candidates; one formula is new to the registry."""
    from pyspark.sql import Window

    text = F.when(c(FACTOR) == "surge", "rank(surge, new)").otherwise(F.concat(F.lit("rank("), c(FACTOR), F.lit(")")))
    df = mined(spark, sf, wide).select(FACTOR, text.alias("formula"), "ic", "ic_ir", c("score").alias("composite_score"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("composite_score"), FACTOR)
    df = df.withColumn("rank", F.row_number().over(order))
    return df.withColumn(FACTOR, F.when(c(FACTOR) == "surge", "surge_new").otherwise(c(FACTOR)))


part(
    "plan",
    ["mined", "registry"],
    """SELECT *, CASE WHEN active THEN 'refresh' WHEN row_number() OVER (PARTITION BY active ORDER BY rank) > least(3, greatest(0, 30 - n_active)) THEN 'wait'
       WHEN status IS NOT NULL THEN 'repromote' ELSE 'promote' END AS action FROM (
         SELECT c.*, r.status, coalesce(r.status = 'promoted', FALSE) AS active, (SELECT count(*) FROM registry WHERE status = 'promoted') AS n_active FROM (
           SELECT CASE factor_id WHEN 'surge' THEN 'surge_new' ELSE factor_id END AS factor_id, CASE factor_id WHEN 'surge' THEN 'rank(surge, new)' ELSE 'rank(' || factor_id || ')' END AS formula,
             score, row_number() OVER (ORDER BY score DESC, factor_id) AS rank FROM mined) c LEFT JOIN registry r USING (formula))""",
)


@query("promotion_plan", with_("plan", "SELECT factor_id, formula, rank, action FROM plan"))
def promotion_plan(spark, sf):
    wide = B.stored_inputs(spark, sf, ("fwd_5", *FORWARD))
    plan = L.promotion_plan(candidates(spark, sf, wide), registry(spark, sf, wide))
    return shaped(plan.select(FACTOR, "formula", "rank", "action"))


@query(
    "promoted_registry",
    with_(
        "registry plan",
        """SELECT coalesce(r.factor_id, p.factor_id) AS factor_id, formula, CASE WHEN p.action IN ('promote', 'repromote') THEN 'promoted' ELSE r.status END AS status,
        CASE WHEN p.action IN ('promote', 'repromote') THEN 0 ELSE r.health_watch_count END AS health_watch_count,
        round(coalesce(p.score, r.composite_score), 6) AS composite_score
        FROM registry r FULL JOIN (SELECT * FROM plan WHERE action <> 'wait') p USING (formula)""",
    ),
)
def promoted_registry(spark, sf):
    wide = B.stored_inputs(spark, sf, ("fwd_5", *FORWARD))
    reg = cut(registry(spark, sf, wide))
    plan = cut(L.promotion_plan(candidates(spark, sf, wide), reg))
    out = L.promoted_registry(reg, plan, "us", F.lit(NOW).cast("timestamp"))
    return shaped(out.select(FACTOR, "formula", "status", "health_watch_count", "composite_score"))


@query(
    "candidate_upsert",
    with_(
        "mined",
        f"""SELECT '{TODAY}' AS date, factor_id, ic, CASE WHEN ic < 0 THEN 2 ELSE 1 END AS rank FROM mined""",
    ),
)
def candidate_upsert(spark, sf):
    """Today's rows stored twice: the second write wins."""
    rows = cut(mined(spark, sf).select(F.lit(TODAY).cast("date").alias("date"), F.lit("us").alias("market"), FACTOR, "ic", F.lit(1).alias("rank")))
    first = ST.conformed(rows, "daily_candidates")
    again = ST.conformed(rows.where(c("ic") < 0).withColumn("rank", F.lit(2)), "daily_candidates")
    out = ST.upsert(first, again, ST.KEYS["daily_candidates"])
    return shaped(out.select("date", FACTOR, "ic", "rank"))


# --- feedback --------------------------------------------------------------
# How events stand in for post-mortem rows.
LABELS = {
    "click": ("missed_alpha", "boost_recall"),
    "view": ("stale_chase", "penalize_stale_chase"),
    "error": ("false_positive", "penalize_false_positive"),
    "purchase": ("won_and_executable", "reward_executable_capture"),
    "signup": ("ignored", "none"),
}


def postmortem(spark, sf):
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in LABELS.items() for x in (k, v[i])]), c("event_type"))
    k = F.get_json_object("props", "$.k").cast("int")
    intent = F.when(k < 5, F.lit('{"action_intent": "observe"}')).otherwise(c("props"))
    return B.table(spark, sf, "events").select(
        c("user_id").cast("string").alias(SYMBOL),
        pick(0).alias("label"),
        F.to_date("ts").alias("evaluation_date"),
        pick(1).alias("feedback_action"),
        (c("value") - 5).alias("feedback_weight"),
        F.when(k >= 95, "Observe").alias("action_label"),
        intent.alias("detail_json"),
    )


part(
    "postmortem",
    [],
    "SELECT CAST(user_id AS VARCHAR) AS symbol, CASE event_type "
    + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in LABELS.items())
    + " END AS label, CAST(ts AS DATE) AS evaluation_date, event_type, value - 5 AS w, CAST(json_extract(props, '$.k') AS INT) AS k FROM events",
)
part(
    "usable",
    ["postmortem"],
    """SELECT * FROM postmortem WHERE evaluation_date >= (SELECT max(evaluation_date) FROM postmortem) - 15 AND w > 0 AND k BETWEEN 5 AND 94""",
)
part(
    "buckets",
    ["usable"],
    """SELECT CASE label WHEN 'missed_alpha' THEN 'missed_alpha' WHEN 'stale_chase' THEN 'stale' WHEN 'false_positive' THEN 'false_positive' ELSE 'captured' END AS bucket,
       symbol, sum(w) AS weight FROM usable WHERE label <> 'ignored' GROUP BY 1, 2""",
)


def feedback(spark, sf):
    rows = ST.feedback_source(postmortem(spark, sf))
    last = rows.agg(F.max("evaluation_date")).first()[0]
    return FB.recent_feedback(rows, F.lit(last), days=15)


@query("recent_feedback", with_("usable", "SELECT symbol, label, strftime(evaluation_date, '%Y-%m-%d') AS evaluation_date, round(w, 2) AS feedback_weight FROM usable"))
def recent_feedback(spark, sf):
    return shaped(feedback(spark, sf).select(SYMBOL, "label", "evaluation_date", "feedback_weight"), 2)


@query("feedback_buckets", with_("buckets", "SELECT bucket, symbol, round(weight, 2) AS weight FROM buckets"))
def feedback_buckets(spark, sf):
    return shaped(FB.feedback_weights(feedback(spark, sf)), 2)


@query(
    "feedback_fallback_source",
    with_("postmortem", "SELECT label, count(*) AS n, round(sum(w), 2) AS weight FROM postmortem WHERE label = 'stale_chase' GROUP BY label"),
)
def feedback_fallback_source(spark, sf):
    """The current table has no usable row, so the older table with fewer columns is read."""
    now = postmortem(spark, sf).where(c("label") == "no such label").drop("action_label", "detail_json")
    old = postmortem(spark, sf).where(c("label") == "stale_chase").select(
        SYMBOL, "label", "evaluation_date", c("feedback_action").alias("factor_feedback_action"),
        c("feedback_weight").alias("factor_feedback_weight"),
    )
    rows = ST.feedback_source(now, old)
    return shaped(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("feedback_weight").alias("weight")), 2)


part(
    "basket",
    ["snap", "multi"],
    """SELECT factor_id, symbol, n FROM (SELECT factor_id, symbol, row_number() OVER (PARTITION BY factor_id ORDER BY CASE direction WHEN 'short' THEN value ELSE -value END, symbol) AS rn,
       count(*) OVER (PARTITION BY factor_id) AS n FROM snap JOIN multi USING (factor_id)) WHERE rn <= greatest(10, least(50, floor(n * 0.03)))""",
)
part(
    "overlap",
    ["basket", "buckets"],
    """SELECT factor_id, count(DISTINCT b.symbol) AS basket_n, """
    + ", ".join(
        f"round(coalesce(sum(weight) FILTER (WHERE bucket = '{k}'), 0) / greatest(1, count(DISTINCT b.symbol) / 5.0), 4) AS {k}_overlap" for k in FB.BUCKETS
    )
    + " FROM basket b LEFT JOIN buckets k ON k.symbol = b.symbol GROUP BY factor_id",
)


def overlap(spark, sf):
    df = B.signals(spark, sf).where((c(DATE) <= F.lit("2000-12-31").cast("date")) & c(VALUE).isNotNull())
    directions = multi_horizon(spark, sf).select(FACTOR, "direction")
    return FB.overlaps(FB.baskets(H.latest_snapshot(df), directions), FB.feedback_weights(feedback(spark, sf)))


@query("feedback_overlap", with_("overlap", f"SELECT factor_id, basket_n, {', '.join(f'round({k}_overlap, 2) AS {k}_overlap' for k in FB.BUCKETS)} FROM overlap"))
def feedback_overlap(spark, sf):
    return shaped(overlap(spark, sf), 2)


@query(
    "feedback_overlay",
    with_(
        "overlap multi",
        """SELECT factor_id, round(score, 2) AS feedback_score, round(least(greatest(1 + (least(greatest(1 + 0.25 * score, 0.85), 1.2) - 1) * 0.8, 0.85), 1.2), 4) AS feedback_multiplier,
        round(composite_score * least(greatest(1 + (least(greatest(1 + 0.25 * score, 0.85), 1.2) - 1) * 0.8, 0.85), 1.2), 6) AS rank_score FROM (
          SELECT factor_id, composite_score, round(1.3 * missed_alpha_overlap + 0.35 * captured_overlap - 0.75 * stale_overlap - false_positive_overlap, 4) AS score
          FROM multi JOIN overlap USING (factor_id))""",
    ),
)
def feedback_overlay(spark, sf):
    cands = multi_horizon(spark, sf).select(
        FACTOR, "composite_score", c("composite_score").alias("rank_score"), F.lit(0.8).alias("n_eff_shrinkage")
    )
    out = FB.with_overlay(cands, overlap(spark, sf))
    return shaped(out.select(FACTOR, "feedback_score", "feedback_multiplier", "rank_score"), feedback_score=2, feedback_multiplier=4)


# --- experiment logs -------------------------------------------------------
def log_lines(spark, sf):
    """One JSON line per event; error events leave broken lines."""
    e = B.table(spark, sf, "events")
    oos = F.when(c("event_type") == "purchase", "PASS")
    rec = F.to_json(
        F.struct(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"),
            F.concat(F.lit("s"), c("user_id")).alias("session_id"),
            F.when(c("user_id") % 2 == 0, "us").otherwise("cn").alias("market"),
            F.concat(F.lit("run"), F.lpad(c("event_id").cast("string"), 9, "0")).alias("name"),
            F.concat(F.lit("rank("), c("event_type"), F.lit(")")).alias("formula"),
            (c("value") / 1000).alias("is_ic"),
            (c("value") / 100).alias("is_ic_ir"),
            F.when(c("event_type").isin("purchase", "click"), "PASS").otherwise("FAIL").alias("gates"),
            oos.alias("oos"),
            F.when(c("user_id") < 10, "revert").alias("decision"),
        )
    )
    return e.select(F.when(c("event_type") == "error", F.substring(rec, 1, 40)).otherwise(rec).alias("line"))


part(
    "runs",
    [],
    """SELECT *, CASE WHEN user_id < 10 THEN 'revert' WHEN event_type = 'purchase' THEN 'keep' WHEN event_type = 'click' THEN 'candidate' ELSE 'revert' END AS decision,
       'run' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS name, value / 100 AS ir FROM events WHERE event_type <> 'error'""",
)


def runs(spark, sf):
    return LG.session_runs(LG.parse_lines(log_lines(spark, sf)))


@query(
    "session_runs",
    with_(
        "runs",
        """SELECT name, decision, CASE WHEN decision = 'keep' THEN 'passed' ELSE 'skipped' END AS checks_status,
        CASE decision WHEN 'keep' THEN 'kept' WHEN 'candidate' THEN 'candidate' ELSE 'reverted' END AS status FROM runs""",
    ),
)
def session_runs(spark, sf):
    return runs(spark, sf).select("name", "decision", "checks_status", "status")


@query(
    "session_summary",
    with_(
        "runs",
        """SELECT count(*) AS total_runs, count(*) FILTER (WHERE decision = 'keep') AS keep_count, count(*) FILTER (WHERE decision = 'revert') AS revert_count,
        count(*) FILTER (WHERE decision = 'candidate') AS candidate_count, count(*) FILTER (WHERE event_type IN ('purchase', 'click')) AS gates_pass,
        count(*) FILTER (WHERE event_type = 'purchase') AS oos_pass, arg_max(name, (ir, name)) AS best_run, round(max(ir), 4) AS best_ic_ir,
        round(abs(max(ir) - median(ir)) / mad(ir), 2) AS confidence_score FROM runs""",
    ),
)
def session_summary(spark, sf):
    return shaped(LG.session_summary(runs(spark, sf)), 4, confidence_score=2)


@query(
    "log_by_day",
    with_("runs", "SELECT name, market FROM (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'us' ELSE 'cn' END AS market FROM runs) WHERE CAST(ts AS DATE) = DATE '2024-01-15'"),
)
def log_by_day(spark, sf):
    log = LG.parse_lines(log_lines(spark, sf))
    both = LG.union_logs(log.where(c("market") == "us"), log.where(c("market") == "cn"))
    return LG.on_day(both, "2024-01-15").select("name", "market")


@query(
    "log_append_idempotent",
    with_(
        "runs",
        """SELECT name, 's' || user_id AS session_id, CASE WHEN event_type = 'purchase' THEN 'PASS' END AS oos FROM runs
        WHERE user_id NOT IN (SELECT user_id FROM runs WHERE CAST(ts AS DATE) < DATE '2024-01-03')""",
    ),
)
def log_append_idempotent(spark, sf):
    """Sessions already in the log (its first two days) are not appended again."""
    parsed = LG.parse_lines(log_lines(spark, sf))
    stored = parsed.where(c("ts") < "2024-01-03")
    oos = parsed.where(c("oos") == "PASS").select("formula", "oos")
    return LG.new_rows(stored, parsed, oos).select("name", "session_id", "oos")
