"""IC, quintiles, turnover, walk-forward, gates, mining, correlation, bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.columns import DATE, FACTOR, SYMBOL, VALUE
from sigloom.operators import bootstrap as BS, correlation as CR, dayscores as DS, gates as G, health as H, ic as IC, indicators as I, panel as P
from sigloom.operators import quintiles as Q, walkforward as WF
from sigloom.operators.longform import wide_signals
from sigloom.plans import mining as M, report as RP
from sigloom.session import cut

from . import testbed as B
from .registry import query, shaped
from .sql import avg_rank, corr, day, inverse_parts, part, qlabel, with_

c = F.col

# --- shared SQL ------------------------------------------------------------
part("pairs", ["signals"], "SELECT *, fwd_5 AS fwd FROM signals WHERE value IS NOT NULL AND fwd_5 IS NOT NULL")
part(
    "ranked",
    ["pairs"],
    f"""SELECT *, {avg_rank('value', 'factor_id, date')} AS rv, {avg_rank('fwd', 'factor_id, date')} AS rf,
        count(*) OVER (PARTITION BY factor_id, date) AS n, {qlabel('value', 'factor_id, date')} AS q FROM pairs""",
)
part(
    "ic",
    ["ranked"],
    f"""SELECT * FROM (SELECT factor_id, date, {corr('rv', 'rf')} AS ic, count(*) AS n_stocks FROM ranked GROUP BY factor_id, date)
        WHERE n_stocks >= 10 AND ic IS NOT NULL""",
)
_QS = ", ".join(f"avg(fwd) FILTER (WHERE q = {k}) AS q{k}" for k in range(1, 6))
part(
    "qdays",
    ["ranked"],
    f"""SELECT factor_id, date, {_QS} FROM ranked WHERE n >= 25 GROUP BY factor_id, date HAVING count(DISTINCT q) = 5""",
)
# turnover by explicit membership: each end compared with the series' previous date if that was usable
part(
    "chain",
    ["signals", "qdays"],
    """SELECT factor_id, date, CASE WHEN lag(ok) OVER w THEN lag(date) OVER w END AS prev_date, ok FROM (
       SELECT s.factor_id, s.date, q.date IS NOT NULL AS ok FROM (SELECT DISTINCT factor_id, date FROM signals) s
       LEFT JOIN qdays q ON q.factor_id = s.factor_id AND q.date = s.date) WINDOW w AS (PARTITION BY factor_id ORDER BY date)""",
)
part(
    "ends",
    ["ranked", "chain"],
    """SELECT r.factor_id, r.date, r.symbol, r.q, k.prev_date FROM ranked r JOIN chain k
       ON k.factor_id = r.factor_id AND k.date = r.date AND k.ok WHERE r.q IN (1, 5)""",
)
part(
    "ls",
    ["qdays", "ends"],
    """SELECT d.factor_id, d.date, d.q5 - d.q1 AS ls_return, t.turnover, d.q1, d.q2, d.q3, d.q4, d.q5 FROM qdays d LEFT JOIN (
        SELECT factor_id, date, (sum(CASE WHEN q = 5 THEN gone END) / sum(CASE WHEN q = 5 THEN 1 END)
          + sum(CASE WHEN q = 1 THEN gone END) / sum(CASE WHEN q = 1 THEN 1 END)) / 2 AS turnover FROM (
          SELECT e.factor_id, e.date, e.q, CASE WHEN p.symbol IS NULL THEN 1.0 ELSE 0.0 END AS gone FROM ends e
          LEFT JOIN ends p ON p.factor_id = e.factor_id AND p.date = e.prev_date AND p.symbol = e.symbol AND p.q = e.q
          WHERE e.prev_date IS NOT NULL) GROUP BY factor_id, date) t USING (factor_id, date)""",
)


def mono_sql(qs=("q1", "q2", "q3", "q4", "q5")) -> str:
    """Spearman of 1..5 with five means."""
    ranks = [
        "(1 + " + " + ".join(f"(CASE WHEN {o} < {q} THEN 1 WHEN {o} = {q} THEN 0.5 ELSE 0 END)" for o in qs if o != q) + ")"
        for q in qs
    ]
    num = " + ".join(f"({i + 1} - 3) * ({r} - 3)" for i, r in enumerate(ranks))
    den = " + ".join(f"({r} - 3) ** 2" for r in ranks)
    return f"coalesce(({num}) / nullif(sqrt(10 * ({den})), 0), 0)"


part("ids", [], "SELECT unnest(['mom', 'range', 'rev', 'surge', 'vol', 'vpdiv']) AS f")

# --- IC --------------------------------------------------------------------
@query("daily_ic", with_("ic", f"SELECT factor_id, {day('date')}, round(ic, 6) AS ic, n_stocks FROM ic"))
def daily_ic(spark, sf):
    return shaped(IC.daily_ic(B.signals(spark, sf), width=B.width(spark, sf)))


_SUMMARY = """SELECT factor_id, round(avg(ic), 4) AS ic_mean, round(stddev_samp(ic), 4) AS ic_std,
 round(avg(ic) / stddev_samp(ic), 3) AS ic_ir, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END) * 100, 1) AS ic_positive_pct,
 count(ic) AS n_days FROM ic GROUP BY factor_id"""


@query("ic_summary", with_("ic", _SUMMARY))
def ic_summary(spark, sf):
    return shaped(IC.ic_summary(IC.daily_ic(B.signals(spark, sf), width=B.width(spark, sf))))


_LOG_MOVES = """SELECT *, ln(close) - lag(ln(close)) OVER w AS lr,
 lag(ln(close)) OVER w - lag(ln(close), 2) OVER w AS lr1 FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY bar_no)"""
part("logmoves", ["panel"], _LOG_MOVES)
_P19 = "OVER (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING)"
part(
    "regimes",
    ["logmoves"],
    f"""SELECT symbol, date, CASE WHEN ac > 0.15 THEN 'trending' WHEN ac < -0.10 THEN 'mean_reverting' ELSE 'noisy' END AS regime
        FROM (SELECT symbol, date, CASE WHEN bar_no >= 22 THEN {corr('lr1', 'lr', ' ' + _P19)} END AS ac FROM logmoves)""",
)


@query(
    "ic_by_regime",
    with_(
        "pairs regimes ids",
        f"""SELECT k.f AS factor_id, k.regime, round(m, 4) AS ic_mean, round(m / s, 3) AS ic_ir,
        CASE WHEN coalesce(r.n, 0) >= 20 THEN coalesce(d.n, 0) ELSE coalesce(r.n, 0) END AS n_obs
        FROM (SELECT f, unnest(['trending', 'mean_reverting', 'noisy']) AS regime FROM ids) k
        LEFT JOIN (SELECT factor_id AS f, regime, count(*) AS n FROM pairs JOIN regimes USING (symbol, date) GROUP BY ALL) r USING (f, regime)
        LEFT JOIN (SELECT factor_id AS f, regime, avg(ic) AS m, stddev_pop(ic) AS s, count(ic) AS n
        FROM (SELECT factor_id, regime, date, {corr('rv', 'rf')} AS ic FROM (
          SELECT factor_id, regime, date, {avg_rank('value', 'factor_id, regime, date')} AS rv,
            {avg_rank('fwd', 'factor_id, regime, date')} AS rf FROM pairs JOIN regimes USING (symbol, date))
          GROUP BY factor_id, regime, date HAVING count(*) >= 10) GROUP BY factor_id, regime) d USING (f, regime)""",
    ),
)
def ic_by_regime(spark, sf):
    w = B.width(spark, sf)
    df = I.with_log_returns(B.wide_inputs(spark, sf)).select(SYMBOL, DATE, *B.FACTORS, "fwd_5", I.regime().alias("regime"))
    return shaped(RP.regime_columns(cut(df), B.FACTORS, "fwd_5", w))


@query(
    "rolling_ic",
    with_(
        "ic",
        f"""SELECT factor_id, {day('date')}, round(CASE WHEN count(ic) OVER (w ROWS 59 PRECEDING) >= 30
        THEN avg(ic) OVER (w ROWS 59 PRECEDING) END, 6) AS rolling_ic, round(avg(ic) OVER w, 6) AS cumulative_ic
        FROM ic WINDOW w AS (PARTITION BY factor_id ORDER BY date)""",
    ),
)
def rolling_ic(spark, sf):
    return shaped(IC.rolling_ic(IC.daily_ic(B.signals(spark, sf), width=B.width(spark, sf))))


@query(
    "ic_trend",
    with_(
        "ic",
        """SELECT factor_id, round(b, 6) AS slope, round(b * 252, 4) AS slope_per_year, round(r2, 4) AS r_squared, n_days,
        CASE WHEN abs(b * 252) < 0.005 THEN 'stable' WHEN b < 0 THEN 'decaying' ELSE 'improving' END AS verdict
        FROM (SELECT factor_id, regr_slope(ic, i) AS b, regr_r2(ic, i) AS r2, count(*) AS n_days FROM
          (SELECT *, row_number() OVER (PARTITION BY factor_id ORDER BY date) - 1 AS i FROM ic) GROUP BY factor_id)""",
    ),
)
def ic_trend(spark, sf):
    return shaped(IC.ic_trend(IC.daily_ic(B.signals(spark, sf), width=B.width(spark, sf))))


# --- quintiles and turnover ------------------------------------------------
@query(
    "quintile_returns",
    with_(
        "qdays",
        f"""SELECT factor_id, {', '.join(f'round(q{k} * 100, 3) AS q{k}' for k in range(1, 6))},
        round((q5 - q1) * 100, 3) AS long_short_pct, round({mono_sql()}, 3) AS monotonicity, n_days
        FROM (SELECT factor_id, {', '.join(f'avg(q{k}) AS q{k}' for k in range(1, 6))}, count(*) AS n_days FROM qdays GROUP BY factor_id)""",
    ),
)
def quintile_returns(spark, sf):
    pairs = Q.labelled(B.signals(spark, sf), "fwd_5", width=B.width(spark, sf))
    return shaped(Q.quintile_returns(Q.daily_scores(pairs, "fwd_5")))


@query(
    "long_short",
    with_("ls", f"SELECT factor_id, {day('date')}, round(ls_return, 5) AS ls_return, round(turnover, 6) AS turnover FROM ls"),
)
def long_short(spark, sf):
    df = Q.long_short(B.signals(spark, sf), "fwd_5", width=B.width(spark, sf))
    return shaped(df.select(FACTOR, DATE, "ls_return", "turnover"), ls_return=5)


part(
    "tops",
    ["signals"],
    """SELECT factor_id, date, symbol, n >= 10 AS ok, greatest(floor(n * 0.2), 1) AS k FROM (
       SELECT factor_id, date, symbol, count(*) OVER (PARTITION BY factor_id, date) AS n,
       row_number() OVER (PARTITION BY factor_id, date ORDER BY value DESC, symbol) AS rn FROM signals WHERE value IS NOT NULL)
       WHERE rn <= greatest(floor(n * 0.2), 1)""",
)
part(
    "top_turnover",
    ["tops"],
    """SELECT c.factor_id, c.date, 1 - count(p.symbol) / max(c.k) AS turnover FROM (
         SELECT factor_id, date, ok, lag(date) OVER w AS prev_date, lag(ok) OVER w AS prev_ok, k FROM
         (SELECT DISTINCT factor_id, date, ok, k FROM tops) WINDOW w AS (PARTITION BY factor_id ORDER BY date)) c
       JOIN tops t ON t.factor_id = c.factor_id AND t.date = c.date
       LEFT JOIN tops p ON p.factor_id = c.factor_id AND p.date = c.prev_date AND p.symbol = t.symbol
       WHERE c.ok AND c.prev_ok GROUP BY c.factor_id, c.date""",
)


@query("top_turnover", with_("top_turnover", f"SELECT factor_id, {day('date')}, round(turnover, 6) AS turnover FROM top_turnover"))
def top_turnover(spark, sf):
    return shaped(Q.top_turnover(B.signals(spark, sf).select(FACTOR, SYMBOL, DATE, VALUE), width=B.width(spark, sf)))


@query(
    "turnover_summary",
    with_(
        "top_turnover",
        "SELECT factor_id, round(avg(turnover), 4) AS avg_daily, round(avg(turnover) * 21, 4) AS avg_monthly, count(*) AS n_days FROM top_turnover GROUP BY factor_id",
    ),
)
def turnover_summary(spark, sf):
    daily = Q.top_turnover(B.signals(spark, sf).select(FACTOR, SYMBOL, DATE, VALUE), width=B.width(spark, sf))
    return shaped(Q.turnover_summary(daily))


# --- walk-forward ----------------------------------------------------------
part(
    "folds",
    ["panel"],
    f"""SELECT date, fold FROM (SELECT date, CAST(floor((i - 120) / greatest(60, floor((n - 120) / 2))) AS INT) AS fold, n FROM (
          SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (
            SELECT date, row_number() OVER (ORDER BY date DESC) AS back FROM (SELECT DISTINCT date FROM panel) WHERE date < DATE '{B.OOS_START}')
          WHERE back > 5) WHERE i >= 120 AND n - 120 >= 60) WHERE fold < 2
        QUALIFY count(*) OVER (PARTITION BY fold) >= 30""",
)
# the chain restarts with each fold
part(
    "fold_ls",
    ["ls", "chain", "folds"],
    """SELECT l.factor_id, l.date, f.fold, l.ls_return, CASE WHEN pf.fold = f.fold THEN l.turnover END AS turnover,
       l.q1, l.q2, l.q3, l.q4, l.q5 FROM ls l JOIN folds f USING (date)
       JOIN chain k ON k.factor_id = l.factor_id AND k.date = l.date LEFT JOIN folds pf ON pf.date = k.prev_date""",
)
part(
    "fold_metrics",
    ["fold_ls", "ic", "signals"],
    f"""SELECT s.factor_id, s.fold, s.test_start, s.test_end, round(i.m, 4) AS ic, round(i.m / i.s, 3) AS ic_ir,
        round((ls / 5 - turnover * 0.003) / (sd / 5) * sqrt(252), 3) AS sharpe, round(turnover, 4) AS turnover,
        round({mono_sql()}, 3) AS monotonicity, s.n_test_days
        FROM (SELECT factor_id, fold, min(date) AS test_start, max(date) AS test_end, count(DISTINCT date) AS n_test_days
              FROM signals JOIN folds USING (date) GROUP BY factor_id, fold) s
        JOIN (SELECT factor_id, fold, avg(ic) AS m, stddev_samp(ic) AS s FROM ic JOIN folds USING (date) GROUP BY factor_id, fold) i
          USING (factor_id, fold)
        JOIN (SELECT factor_id, fold, avg(ls_return) AS ls, stddev_pop(ls_return) AS sd, coalesce(avg(turnover), 0) AS turnover,
              {', '.join(f'avg(q{k}) AS q{k}' for k in range(1, 6))} FROM fold_ls GROUP BY factor_id, fold) l USING (factor_id, fold)""",
)
part(
    "averages",
    ["fold_metrics"],
    """SELECT factor_id, round(avg(ic), 4) AS avg_ic, round(avg(ic_ir), 3) AS avg_ic_ir, round(avg(sharpe), 3) AS avg_sharpe,
       round(avg(turnover), 4) AS avg_turnover, round(avg(monotonicity), 3) AS avg_monotonicity, count(*) AS n_folds
       FROM fold_metrics GROUP BY factor_id""",
)


def fold_metrics(spark, sf, wide=None, rows=None):
    """A rank orders names as its input does, so inputs are scored as they are. ``wide``: ``B.stored_inputs``, ``rows``: its ``DS.date_rows``, where at hand."""
    w = B.width(spark, sf)
    wide = B.stored_inputs(spark, sf) if wide is None else wide
    folds = cut(WF.fold_dates(P.trade_dates(wide), B.OOS_START))
    if DS.fits(wide, w):
        return WF.fold_columns(wide, B.FACTORS, folds, "fwd_5", cost=0.003, rows=rows)
    return WF.fold_metrics(B.signals(spark, sf, wide=wide), folds, "fwd_5", cost=0.003, width=w)


@query(
    "walk_forward_folds",
    with_(
        "fold_metrics",
        f"""SELECT factor_id, fold, {day('test_start')}, {day('test_end')}, ic, ic_ir, sharpe, turnover, monotonicity, n_test_days
        FROM fold_metrics""",
    ),
)
def walk_forward_folds(spark, sf):
    return shaped(fold_metrics(spark, sf))


@query("walk_forward", with_("averages", "SELECT * FROM averages"))
def walk_forward(spark, sf):
    return shaped(WF.walk_forward(fold_metrics(spark, sf)))


@query(
    "oos_check",
    with_(
        "ic",
        f"""SELECT factor_id, abs(avg(ic)) >= 0.01 AND avg(ic) / stddev_samp(ic) > 0 AS oos_pass FROM ic
        WHERE date >= DATE '{B.OOS_START}' GROUP BY factor_id""",
    ),
)
def oos_check(spark, sf):
    return WF.oos_check(B.signals(spark, sf), B.OOS_START, "cn", width=B.width(spark, sf))


# --- correlation -----------------------------------------------------------
part(
    "pair_days",
    ["signals"],
    f"""SELECT a, b, date, {corr('ra', 'rb')} AS rho, count(*) AS n FROM (
        SELECT x.factor_id AS a, y.factor_id AS b, x.date, {avg_rank('x.value', 'x.factor_id, y.factor_id, x.date')} AS ra,
        {avg_rank('y.value', 'x.factor_id, y.factor_id, x.date')} AS rb
        FROM signals x JOIN signals y ON x.symbol = y.symbol AND x.date = y.date AND x.factor_id < y.factor_id
        WHERE x.value IS NOT NULL AND y.value IS NOT NULL) GROUP BY a, b, date""",
)
part(
    "matrix",
    ["pair_days", "panel"],
    """SELECT a, b, round(avg(rho), 3) AS rho FROM pair_days WHERE n >= 10
       AND date IN (SELECT date FROM panel GROUP BY date HAVING count(*) >= 20) GROUP BY a, b""",
)
part("abs_corr", ["pair_days"], "SELECT a, b, avg(abs(rho)) FILTER (WHERE n >= 10) AS abs_corr, sum(n) AS n FROM pair_days GROUP BY a, b")


@query(
    "correlation_matrix",
    with_(
        "matrix ids",
        """SELECT x.f AS a, y.f AS b, CASE WHEN x.f = y.f THEN 1.0 ELSE coalesce(m.rho, 0) END AS rho FROM ids x CROSS JOIN ids y
        LEFT JOIN matrix m ON (m.a = least(x.f, y.f) AND m.b = greatest(x.f, y.f))""",
    ),
)
def correlation_matrix(spark, sf):
    wide = B.wide_inputs(spark, sf)
    return shaped(CR.correlation_matrix(wide, B.FACTORS, width=B.width(spark, sf)))


@query("redundant_pairs", with_("matrix", "SELECT a, b, rho FROM matrix WHERE abs(rho) >= 0.1"))
def redundant_pairs(spark, sf):
    matrix = CR.correlation_matrix(B.wide_inputs(spark, sf), B.FACTORS, width=B.width(spark, sf))
    return shaped(CR.redundant_pairs(matrix, 0.1))


@query(
    "absolute_correlation",
    with_("abs_corr", "SELECT a, b, round(CASE WHEN n > 100 THEN coalesce(abs_corr, 0) ELSE 0 END, 6) AS abs_corr FROM abs_corr"),
)
def absolute_correlation(spark, sf):
    return shaped(CR.absolute_correlation(B.wide_inputs(spark, sf), B.FACTORS, 100, B.width(spark, sf)))


@query(
    "factor_pair_alignment",
    with_(
        "signals",
        """SELECT x.factor_id AS a, y.factor_id AS b, count(*) AS n FROM signals x JOIN signals y
        ON x.symbol = y.symbol AND x.date = y.date AND x.factor_id < y.factor_id
        WHERE x.value IS NOT NULL AND y.value IS NOT NULL GROUP BY ALL""",
    ),
)
def factor_pair_alignment(spark, sf):
    pairs = CR.pair_summary(B.wide_inputs(spark, sf), B.FACTORS, width=B.width(spark, sf))
    return pairs.where("a < b AND common > 0").select("a", "b", c("common").alias("n"))


# --- gates, scores, mining -------------------------------------------------
GATE_DAY = "2000-12-31"
# A close relative of one factor is already promoted, so that one adds little beside the others.
part(
    "gate_snap",
    ["signals"],
    f"""SELECT *, rev * rev AS echo FROM (SELECT symbol, {", ".join(f"max(value) FILTER (WHERE factor_id = '{f}') AS {f}" for f in B.FACTORS)}
        FROM signals WHERE date = (SELECT max(date) FROM signals WHERE date <= DATE '{GATE_DAY}') GROUP BY symbol)
        WHERE {" AND ".join(f"{f} IS NOT NULL" for f in B.FACTORS)}""",
)
_GATE_INV = inverse_parts("gate", "gate_snap", [*B.FACTORS, "echo"])
part(
    "gate_inputs",
    ["averages", "abs_corr", _GATE_INV],
    f"""SELECT v.*, coalesce(m.max_corr, 0) AS max_corr, round(1 - 1 / d.v, 3) AS r_squared FROM averages v LEFT JOIN (
       SELECT f, max(abs_corr) AS max_corr FROM (SELECT a AS f, abs_corr FROM abs_corr UNION ALL SELECT b, abs_corr FROM abs_corr)
       GROUP BY f) m ON m.f = v.factor_id
       JOIN {_GATE_INV} d ON d.i = d.j AND [{", ".join(f"'{f}'" for f in B.FACTORS)}][d.i + 1] = v.factor_id""",
)
_GATES = [
    ("ic", "round(avg_ic, 4)", "abs(avg_ic) >= 0.01", 0.01),
    ("ic_ir", "round(avg_ic_ir, 3)", "avg_ic_ir >= 0.2", 0.2),
    ("turnover", "round(avg_turnover, 4)", "avg_turnover <= 0.5", 0.5),
    ("monotonicity", "round(avg_monotonicity, 3)", "abs(avg_monotonicity) >= 0.0", 0.0),
    ("correlation", "round(max_corr, 3)", "max_corr < 0.6", 0.6),
    ("multi_collinearity", "round(r_squared, 3)", "r_squared <= 0.85", 0.85),
]


def gate_inputs(spark, sf):
    wide = B.stored_inputs(spark, sf)
    # What is scored of a date is made from the same rows of it, which meet once.
    rows = DS.date_rows(wide, [c(f) for f in B.FACTORS], ["fwd_5"])
    pairs = CR.absolute_correlation(wide, B.FACTORS, 0, B.width(spark, sf), against=B.FACTORS, rows=rows)
    worst = CR.largest_correlation(pairs)
    averages = WF.walk_forward(fold_metrics(spark, sf, wide, rows))
    last = wide.where(c(DATE) <= F.lit(GATE_DAY).cast("date")).agg(F.max(DATE)).first()[0]
    signals = B.signals(spark, sf, wide=wide.where(c(DATE) == F.lit(last)))
    today = wide_signals(signals, B.FACTORS).withColumn("echo", c("rev") * c("rev"))
    redundancy = H.collinearity_of_all(today, [*B.FACTORS, "echo"]).select(FACTOR, "r_squared")
    return averages.join(worst, FACTOR, "left").join(redundancy, FACTOR).withColumn("n_existing", F.lit(6))


@query(
    "check_gates",
    with_(
        "gate_inputs",
        " UNION ALL ".join(
            f"SELECT factor_id, '{g}' AS gate, {ok} AS passed, {v} AS value, {t}::DOUBLE AS threshold FROM gate_inputs"
            for g, v, ok, t in _GATES
        ),
    ),
)
def check_gates(spark, sf):
    return shaped(G.check_gates(gate_inputs(spark, sf), "cn"))


@query(
    "gate_verdict",
    with_(
        "gate_inputs",
        f"SELECT factor_id, {' AND '.join(ok for _, _, ok, _ in _GATES)} AS passed, abs(avg_ic) >= 0.01 AS ic_passed FROM gate_inputs",
    ),
)
def gate_verdict(spark, sf):
    df = G.gate_verdict(gate_inputs(spark, sf), "cn")
    return df.select(FACTOR, "passed", c("gates")["ic"]["passed"].alias("ic_passed"))


part(
    "mined",
    ["ic", "qdays", "pairs"],
    f"""SELECT factor_id, rows, ic, ic_ir, mono, q5_q1, abs(ic) * abs(ic_ir) * CASE WHEN ic * mono >= 0 THEN 1 ELSE -1 END AS score,
        CASE WHEN ic < 0 THEN 'short' ELSE 'long' END AS direction FROM (
        SELECT factor_id, rows, round(m, 4) AS ic, round(m / s, 3) AS ic_ir, round({mono_sql()}, 3) AS mono, round((q5 - q1) * 100, 3) AS q5_q1
        FROM (SELECT factor_id, avg(ic) AS m, stddev_samp(ic) AS s FROM ic GROUP BY 1)
        JOIN (SELECT factor_id, {', '.join(f'avg(q{k}) AS q{k}' for k in range(1, 6))} FROM qdays GROUP BY 1) USING (factor_id)
        JOIN (SELECT factor_id, count(*) AS rows FROM pairs GROUP BY 1) USING (factor_id))""",
)


def mined(spark, sf, wide=None):
    """``wide``: ``B.stored_inputs``, where they are at hand."""
    return M.column_metrics(B.wide_inputs(spark, sf) if wide is None else wide, B.FACTORS, width=B.width(spark, sf))


@query("mining_score", with_("mined", "SELECT factor_id, rows, ic, ic_ir, mono, q5_q1, round(score, 6) AS score, direction FROM mined"))
def mining_score(spark, sf):
    return shaped(mined(spark, sf))


@query(
    "gate_attrition",
    with_(
        "mined",
        """SELECT count(*) AS valid, count(*) FILTER (WHERE abs(ic) >= 0.015) AS ic,
        count(*) FILTER (WHERE abs(ic) >= 0.015 AND abs(ic_ir) >= 0.15) AS ic_ir,
        count(*) FILTER (WHERE abs(ic) >= 0.015 AND abs(ic_ir) >= 0.15 AND abs(mono) >= 0) AS passed FROM mined""",
    ),
)
def gate_attrition(spark, sf):
    return G.attrition(mined(spark, sf), "cn")


@query("top_candidates", with_("mined", "SELECT factor_id, round(score, 6) AS score FROM mined ORDER BY mined.score DESC, factor_id LIMIT 4"))
def top_candidates(spark, sf):
    return shaped(G.best_candidates(mined(spark, sf), 4).select(FACTOR, "score"))


@query(
    "oos_finalists",
    with_("mined", "SELECT factor_id, ic FROM mined WHERE abs(ic) >= 0.015 ORDER BY abs(ic) DESC, factor_id LIMIT 3"),
)
def oos_finalists(spark, sf):
    df = mined(spark, sf).withColumn("passed", F.abs("ic") >= 0.015)
    return shaped(G.oos_finalists(df).select(FACTOR, "ic"))


@query(
    "formula_blacklist",
    """SELECT p_name AS name, formula FROM (SELECT p_name, CASE p_size % 5 WHEN 0 THEN 'rank(-volume / ts_mean(volume, ' || p_size || '))'
       WHEN 1 THEN 'rank( volume )' WHEN 2 THEN 'rank(delta(close, ' || p_size || '))' WHEN 3 THEN 'abs(ret_1d) / (amount + 1)'
       ELSE 'rank(ts_std(ret_1d, ' || p_size || '))' END AS formula FROM part) WHERE formula LIKE 'rank(delta%' OR formula LIKE 'rank(ts_std(ret%'""",
)
def formula_blacklist(spark, sf):
    size = c("p_size").cast("string")
    text = (
        F.when(c("p_size") % 5 == 0, F.concat(F.lit("rank(-volume / ts_mean(volume, "), size, F.lit("))")))
        .when(c("p_size") % 5 == 1, "rank( volume )")
        .when(c("p_size") % 5 == 2, F.concat(F.lit("rank(delta(close, "), size, F.lit("))")))
        .when(c("p_size") % 5 == 3, "abs(ret_1d) / (amount + 1)")
        .otherwise(F.concat(F.lit("rank(ts_std(ret_1d, "), size, F.lit("))")))
    )
    df = B.table(spark, sf, "part").select(c("p_name").alias("name"), text.alias("formula"))
    return df.where(~G.blacklisted(c("formula")))


@query(
    "distinct_formulas",
    """SELECT formula, min(p_partkey) AS p_partkey FROM (SELECT 'rank(delta(close, ' || p_size || '))' AS formula, p_partkey FROM part) GROUP BY formula""",
)
def distinct_formulas(spark, sf):
    text = F.concat(F.lit("rank(delta(close, "), c("p_size").cast("string"), F.lit("))"))
    return G.first_per_formula(B.table(spark, sf, "part").select(text.alias("formula"), "p_partkey"), "p_partkey")


@query(
    "correlation_dedup",
    with_("mined abs_corr", "").replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    + """,
order_ AS (SELECT factor_id, row_number() OVER (ORDER BY score DESC, factor_id) AS i FROM mined),
walk AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS kept UNION ALL
  SELECT o.i, CASE WHEN EXISTS (SELECT 1 FROM abs_corr p WHERE p.abs_corr > 0.12
     AND ((p.a = o.factor_id AND list_contains(w.kept, p.b)) OR (p.b = o.factor_id AND list_contains(w.kept, p.a))))
     THEN w.kept ELSE list_append(w.kept, o.factor_id) END FROM walk w JOIN order_ o ON o.i = w.i + 1)
SELECT unnest(kept) AS factor_id FROM (SELECT kept FROM walk ORDER BY i DESC LIMIT 1)""",
)
def correlation_dedup(spark, sf):
    wide = B.stored_inputs(spark, sf)
    return CR.greedy_distinct(wide, cut(mined(spark, sf, wide)), limit=0.12, min_rows=100, width=B.width(spark, sf)).select(FACTOR)


@query("factor_grid_scores")
def factor_grid_scores(spark, sf):
    """The whole grid scored in one job (checked against the one-by-one path in the tests)."""
    df = B.featured(spark, sf, spread=True).withColumn("fwd_5", P.forward_return(5))
    grid = M.factor_grid()
    return shaped(M.named(M.grid_metrics(df, grid, width=B.width(spark, sf)), grid))


@query(
    "grid_family_scores",
    with_(
        "featured",
        f"""SELECT factor_id, ic, ic_ir FROM (SELECT factor_id, round(avg(ic), 4) AS ic, round(avg(ic) / stddev_samp(ic), 3) AS ic_ir FROM (
        SELECT factor_id, date, {corr('rv', 'rf')} AS ic FROM (SELECT factor_id, date, {avg_rank('v', 'factor_id, date')} AS rv,
          {avg_rank('fwd', 'factor_id, date')} AS rf FROM (
            SELECT 'f_' || substr(md5('rank((close - low) / (high - low + 0.01)) * rank(-pct_change(close, ' || n || '))'), 1, 12) AS factor_id, date, fwd, ({avg_rank('x', 'n, date')} / count(x) OVER (PARTITION BY n, date)) * ({avg_rank('y', 'n, date')} / count(y) OVER (PARTITION BY n, date)) AS v, x, y FROM (
              SELECT 5 AS n, date, lead(close, 5) OVER w / close - 1 AS fwd, (close - low) / (high - low + 0.01) AS x, -(close / lag(close, 5) OVER w - 1) AS y
                FROM featured WINDOW w AS (PARTITION BY symbol ORDER BY bar_no)
              UNION ALL SELECT 10, date, lead(close, 5) OVER w / close - 1, (close - low) / (high - low + 0.01), -(close / lag(close, 10) OVER w - 1)
                FROM featured WINDOW w AS (PARTITION BY symbol ORDER BY bar_no)
              UNION ALL SELECT 20, date, lead(close, 5) OVER w / close - 1, (close - low) / (high - low + 0.01), -(close / lag(close, 20) OVER w - 1)
                FROM featured WINDOW w AS (PARTITION BY symbol ORDER BY bar_no)))
          WHERE fwd IS NOT NULL AND y IS NOT NULL)
        GROUP BY factor_id, date HAVING count(*) >= 10) GROUP BY factor_id)""",
    ),
)
def grid_family_scores(spark, sf):
    """Products of two ranks out of the grid."""
    df = B.featured(spark, sf, spread=True).withColumn("fwd_5", P.forward_return(5))
    w = B.width(spark, sf)
    body = "(close - low) / (high - low + 0.01)"
    grid = [x for x in M.factor_grid() if x.inners in [(body, f"-pct_change(close, {n})") for n in (5, 10, 20)]]
    scored = M.named(M.grid_metrics(df, grid, width=w), grid)
    return shaped(scored.select(FACTOR, "ic", "ic_ir"))


# --- bootstrap -------------------------------------------------------------
RESAMPLES = 100_000
part(
    "cum",
    ["ic"],
    """SELECT factor_id, i, n, m, x, least(n, greatest(5, CAST(round(sqrt(n)) AS BIGINT))) AS bs FROM (SELECT factor_id, ic - avg(ic) OVER f AS x, avg(ic) OVER f AS m,
       row_number() OVER (PARTITION BY factor_id ORDER BY date) - 1 AS i, count(*) OVER f AS n FROM ic WINDOW f AS (PARTITION BY factor_id))""",
)
part(
    "doubled",
    ["cum"],
    """SELECT factor_id, n, m, bs, [0.0] || list(p ORDER BY j) AS prefix FROM (SELECT factor_id, n, m, bs, j, sum(x) OVER (PARTITION BY factor_id ORDER BY j) AS p
       FROM (SELECT *, i AS j FROM cum UNION ALL SELECT *, i + n AS j FROM cum)) GROUP BY ALL""",
)
part(
    "nulls",
    ["doubled"],
    f"""SELECT factor_id, any_value(m) AS m, any_value(n) AS n, any_value(bs) AS bs, r, sum(prefix[s + len + 1] - prefix[s + 1]) / any_value(n) AS x FROM (
        SELECT factor_id, m, n, bs, prefix, r, CAST(('0x' || substr(md5('42:' || r || ':' || b), 1, 8)) AS BIGINT) % n AS s, least(bs, n - b * bs) AS len
        FROM (SELECT *, unnest(range(CAST(ceil(n / bs) AS BIGINT))) AS b FROM (SELECT *, unnest(range({RESAMPLES})) AS r FROM doubled)))
        GROUP BY factor_id, r""",
)


@query(
    "bootstrap_significance",
    with_(
        "nulls",
        """SELECT factor_id, round(any_value(m), 6) AS real_ic, round(avg((abs(x) >= abs(m))::INT), 6) AS p_value, round(avg(x), 6) AS null_mean,
        round(stddev_pop(x), 6) AS null_std, round(avg((x < m)::INT) * 100, 1) AS percentile, avg((abs(x) >= abs(m))::INT) < 0.01 AS significant_01,
        avg((abs(x) >= abs(m))::INT) < 0.05 AS significant_05, count(*) AS n_bootstrap, any_value(bs) AS block_size FROM nulls GROUP BY factor_id""",
    ),
)
def bootstrap_significance(spark, sf):
    daily = IC.daily_ic(B.signals(spark, sf), undefined="zero", width=B.width(spark, sf))
    return shaped(BS.bootstrap_significance(daily, RESAMPLES))
