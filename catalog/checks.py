"""Health, normality, diversity, collinearity, penalties and series diagnostics."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from sigloom.columns import DATE, FACTOR, SYMBOL, VALUE
from sigloom.operators import diagnostics as D, health as H, ic as IC
from sigloom.operators.longform import wide_signals
from sigloom.plans import report as RP
from sigloom.session import cut

from . import testbed as B
from .registry import ORACLES, query, shaped
from .scoring import mono_sql
from .sql import avg_rank, corr, day, eigen_cte, inverse_parts, part, qlabel, with_

c = F.col
SNAP = "2000-12-31"


def daily(spark, sf):
    """IC series: a few numbers per factor and date, read several times below, so written once."""
    return cut(IC.daily_ic(B.signals(spark, sf), width=B.width(spark, sf)))


def snapshot(spark, sf):
    """Wide signals on the last date up to SNAP."""
    df = B.signals(spark, sf).where(c(DATE) <= F.lit(SNAP).cast("date"))
    return cut(wide_signals(H.latest_snapshot(df).withColumn(DATE, F.lit(SNAP).cast("date")), B.FACTORS))


def ep_sql(src: str, by: str, x: str = "ic") -> str:
    grid = ", ".join(str(t) for t in H.T_GRID)
    return f"""SELECT {by}, CASE WHEN max(n) < 10 THEN 0 WHEN max(s) < 1e-12 THEN 999 ELSE max(n) * avg(d) END AS ep FROM (
      SELECT {by}, t, max(n) AS n, max(s) AS s, ((avg(cos(t * z)) - exp(-t * t / 2)) ** 2 + avg(sin(t * z)) ** 2) * exp(-t * t / 2) AS d FROM (
        SELECT {by}, n, s, ({x} - m) / nullif(s, 0) AS z, unnest([{grid}]) AS t FROM (
          SELECT *, avg({x}) OVER (PARTITION BY {by}) AS m, stddev_pop({x}) OVER (PARTITION BY {by}) AS s, count(*) OVER (PARTITION BY {by}) AS n FROM {src}))
      GROUP BY {by}, t) GROUP BY {by}"""


@query("epps_pulley", with_("ic", f"SELECT factor_id, round(ep, 6) AS ep FROM ({ep_sql('ic', 'factor_id')})"))
def epps_pulley(spark, sf):
    return shaped(H.epps_pulley(daily(spark, sf), [FACTOR], "ic"))


part(
    "ic_parts",
    ["ic"],
    """SELECT factor_id, date, ic, w, unnest(CASE WHEN rn <= w THEN ['full', 'recent'] ELSE ['full'] END) AS part FROM (
       SELECT *, least(60, greatest(20, n // 2)) AS w FROM (SELECT *, row_number() OVER (PARTITION BY factor_id ORDER BY date DESC) AS rn,
       count(*) OVER (PARTITION BY factor_id) AS n FROM ic))""",
)
part("ic_ep", ["ic_parts"], ep_sql("ic_parts", "factor_id, part"))
part(
    "health",
    ["ic_parts", "ic_ep"],
    """SELECT factor_id, mr, mf, er, ef, w, abs(mr - mf) / (sf / sqrt(w) + 1e-12) AS drift FROM (
       SELECT factor_id, avg(ic) FILTER (WHERE part = 'recent') AS mr, avg(ic) FILTER (WHERE part = 'full') AS mf,
       stddev_pop(ic) FILTER (WHERE part = 'full') AS sf, max(w) AS w FROM ic_parts GROUP BY factor_id)
       JOIN (SELECT factor_id, max(ep) FILTER (WHERE part = 'recent') AS er, max(ep) FILTER (WHERE part = 'full') AS ef FROM ic_ep GROUP BY 1) USING (factor_id)""",
)
_SCORE = "round(CASE WHEN mr > 0 THEN 0.4 ELSE 0 END + CASE WHEN er < 1 THEN 0.3 ELSE 0 END + CASE WHEN drift < 2 THEN 0.3 ELSE 0 END, 2)"
_CHANGE = "(drift > 3 OR (er > 2 AND ef < 1))"


@query(
    "ic_health",
    with_(
        "health",
        f"""SELECT factor_id, {_SCORE} AS health_score, {_CHANGE} AS regime_change, round(mr, 4) AS ic_mean_recent,
        round(mf, 4) AS ic_mean_full, round(drift, 2) AS drift_z, round(er, 3) AS ep_recent, round(ef, 3) AS ep_full FROM health""",
    ),
)
def ic_health(spark, sf):
    return shaped(H.ic_health(daily(spark, sf)))


part(
    "snap",
    ["signals"],
    f"""SELECT factor_id, symbol, value FROM signals s WHERE value IS NOT NULL AND date = (SELECT max(date) FROM signals t
        WHERE t.factor_id = s.factor_id AND t.value IS NOT NULL AND t.date <= DATE '{SNAP}')
        QUALIFY count(*) OVER (PARTITION BY factor_id) >= 25""",
)


@query("latest_snapshot", with_("snap", "SELECT factor_id, symbol, round(value, 6) AS value FROM snap"))
def latest_snapshot(spark, sf):
    df = B.signals(spark, sf).where(c(DATE) <= F.lit(SNAP).cast("date"))
    df = df.where(c(VALUE).isNotNull())
    return shaped(H.latest_snapshot(df).select(FACTOR, SYMBOL, VALUE))


_Z = ", ".join(
    f"(max(value) FILTER (WHERE factor_id = '{f}')) AS {f}" for f in B.FACTORS
)
part("snapwide", ["snap"], f"SELECT symbol, {_Z} FROM snap GROUP BY symbol HAVING count(*) = {len(B.FACTORS)}")
_DIRS = ", ".join(f"({i}, {', '.join(repr(float(x)) for x in d)})" for i, d in enumerate(H.directions(len(B.FACTORS))))
_NAMES = ", ".join(f"w{i}" for i in range(len(B.FACTORS)))
part("dirs", [], f"SELECT * FROM (VALUES {_DIRS}) AS d(direction, {_NAMES})")
_PROJ = " + ".join(
    f"w{i} * ({f} - avg({f}) OVER ()) / (stddev_pop({f}) OVER () + 1e-12)" for i, f in enumerate(B.FACTORS)
)
part("projected", ["snapwide", "dirs"], f"SELECT direction, x.p FROM (SELECT direction, {_PROJ.replace('OVER ()', 'OVER (PARTITION BY direction)')} AS p FROM snapwide CROSS JOIN dirs) x")
part("ep_dirs", ["projected"], ep_sql("projected", "direction", "p"))


@query(
    "factor_diversity",
    with_(
        "ep_dirs",
        """SELECT round(greatest(0, least(1, 1 - avg(ep) / 2)), 3) AS diversity_score, round(avg(ep), 3) AS mean_ep,
        round(quantile_cont(ep, 0.5), 3) AS ep_median, round(quantile_cont(ep, 0.95), 3) AS ep_p95 FROM ep_dirs""",
    ),
)
def factor_diversity(spark, sf):
    df = H.factor_diversity(snapshot(spark, sf), B.FACTORS)
    return shaped(df.select("diversity_score", "mean_ep", "ep_median", "ep_p95"))


_N_EFF = """(SELECT exp(-sum(l / t * ln(l / t + 1e-12))) AS n_eff FROM (SELECT l, sum(l) OVER () AS t FROM (SELECT unnest(eig) AS l FROM eigen) WHERE l > 0.01))"""


def eigen_(names: str, body: str) -> str:
    """``with_`` plus the eigenvalues of the snapshot's correlations as ``eigen``."""
    head = with_(f"snapwide {names}", "").replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    return head + ",\n" + eigen_cte("eigen", "snapwide", B.FACTORS) + "\n" + body


@query(
    "effective_factor_count",
    eigen_(
        "",
        f"SELECT round(n_eff, 1) AS n_effective, {len(B.FACTORS)}::BIGINT AS n_total, n_eff < {len(B.FACTORS)} * 0.5 AS cluster_warning FROM {_N_EFF}",
    ),
)
def effective_factor_count(spark, sf):
    """exp(entropy) of the eigenvalues of the snapshot's correlations."""
    return shaped(H.factor_diversity(snapshot(spark, sf), B.FACTORS).select("n_effective", "n_total", "cluster_warning"))


def det_sql(cells: list[list[str]]) -> str:
    """Determinant by the permutation sum."""
    n, terms = len(cells), []
    for p in permutations(range(n)):
        odd = sum(p[i] > p[j] for i in range(n) for j in range(i + 1, n)) % 2
        terms.append(("-" if odd else "+") + " " + " * ".join(f"({cells[i][p[i]]})" for i in range(n)))
    return "(" + " ".join(terms) + ")"


_COLS = ["mom", "range", "rev", "surge"]
_CELL = [["1.0" if a == b else f"corr({a}, {b})" for b in _COLS] for a in _COLS]


@query(
    "multi_collinearity",
    with_(
        "snapwide",
        f"""SELECT 'mom' AS factor_id, round(1 - {det_sql(_CELL)} / {det_sql([r[1:] for r in _CELL[1:]])}, 3) AS r_squared,
        1 - {det_sql(_CELL)} / {det_sql([r[1:] for r in _CELL[1:]])} > 0.85 AS is_redundant FROM snapwide""",
    ),
)
def multi_collinearity(spark, sf):
    wide = snapshot(spark, sf).dropna(subset=B.FACTORS)
    return shaped(H.collinearity(wide, "mom", _COLS[1:]).drop("top"))


_INV = inverse_parts("snap6", "snapwide", B.FACTORS)
_LIST = "[" + ", ".join(f"'{f}'" for f in B.FACTORS) + "]"
part(
    "redundancy",
    [_INV],
    f"""SELECT {_LIST}[d.i + 1] AS factor_id, 1 - 1 / d.v AS r2, t.factor AS top_factor, t.beta AS top_beta FROM {_INV} d
        JOIN (SELECT x.i, {_LIST}[x.j + 1] AS factor, abs(x.v / y.v) AS beta, row_number() OVER (PARTITION BY x.i ORDER BY abs(x.v / y.v) DESC) AS rn
          FROM {_INV} x JOIN {_INV} y ON y.i = x.i AND y.j = x.i WHERE x.i <> x.j) t ON t.i = d.i AND t.rn = 1 WHERE d.i = d.j""",
)


@query(
    "redundancy_report",
    with_(
        "redundancy",
        "SELECT factor_id, round(r2, 3) AS r_squared, r2 > 0.85 AS is_redundant, top_factor, round(top_beta, 3) AS top_beta FROM redundancy",
    ),
)
def redundancy_report(spark, sf):
    """Every factor regressed on all others, with the largest coefficient; SQL inverts the matrix by pivoting."""
    out = RP.redundancy_report(snapshot(spark, sf).dropna(subset=B.FACTORS), B.FACTORS)
    first = F.get("top", F.lit(0))
    return shaped(out.select(FACTOR, "r_squared", "is_redundant", first["factor"].alias("top_factor"), first["beta"].alias("top_beta")), 3)


def _without(f: str) -> str:
    """Diversity of the snapshot's factors without ``f``, in SQL."""
    own = [x for x in B.FACTORS if x != f]
    rows = ", ".join(f"({i}, {', '.join(repr(float(x)) for x in d)})" for i, d in enumerate(H.directions(len(own))))
    sums = " + ".join(f"w{i} * ({x} - avg({x}) OVER w) / (stddev_pop({x}) OVER w + 1e-12)" for i, x in enumerate(own))
    part(f"dirs_{f}", [], f"SELECT * FROM (VALUES {rows}) AS d(direction, {', '.join(f'w{i}' for i in range(len(own)))})")
    part(f"projected_{f}", ["snapwide", f"dirs_{f}"], f"SELECT direction, {sums} AS p FROM snapwide CROSS JOIN dirs_{f} WINDOW w AS (PARTITION BY direction)")
    part(f"ep_{f}", [f"projected_{f}"], ep_sql(f"projected_{f}", "direction", "p"))
    return f"SELECT '{f}' AS factor_id, round(greatest(0, least(1, 1 - avg(ep) / 2)), 3) AS diversity_before FROM ep_{f}"


part("diversity_without", [], " UNION ALL ".join(_without(f) for f in B.FACTORS))
from .sql import PARTS  # noqa: E402

PARTS["diversity_without"] = ([f"ep_{f}" for f in B.FACTORS], PARTS["diversity_without"][1])
part(
    "checks",
    ["redundancy", "diversity_without", "ep_dirs"],
    f"""SELECT factor_id, round(r2, 3) AS r_squared, r2 > 0.85 AS is_redundant, diversity_before, diversity_after, round(n_eff, 1) AS n_effective,
        n_eff < {len(B.FACTORS)} * 0.5 AS cluster_warning, {len(B.FACTORS)}::BIGINT AS n_total
        FROM redundancy JOIN diversity_without USING (factor_id)
        CROSS JOIN (SELECT round(greatest(0, least(1, 1 - avg(ep) / 2)), 3) AS diversity_after FROM ep_dirs) CROSS JOIN n_eff""",
)
part(
    "penalty_inputs",
    ["checks", "health", "ic"],
    f"""SELECT c.*, n AS n_ic, {_SCORE} AS health_score, {_CHANGE} AS regime_change, abs(mf) AS composite_score
        FROM checks c JOIN health h USING (factor_id) JOIN (SELECT factor_id, count(*) AS n FROM ic GROUP BY 1) USING (factor_id)""",
)
part(
    "penalties",
    ["penalty_inputs"],
    """SELECT *, 0.45 * CASE WHEN is_redundant THEN greatest(r, 0.8) ELSE r END
        + 0.20 * CASE WHEN cluster_warning AND diversity_after < diversity_before THEN least(1, d + 0.15) ELSE d END
        + 0.35 * CASE WHEN n_ic < 20 THEN 0 WHEN regime_change THEN least(1, h + 0.2) ELSE h END AS total,
        round(least(1, greatest(0.6, sqrt(least(greatest(n_effective, 1), n_total) / n_total))), 4) AS shrink FROM (
        SELECT *, least(1, greatest(0, (r_squared - 0.55) / (0.85 - 0.55))) AS r,
          least(1, greatest(0, (diversity_before - diversity_after) / 0.25)) AS d,
          least(1, greatest(0, (0.60 - health_score) / 0.60)) AS h FROM penalty_inputs)""",
)


def _after_checks(names: str, body: str) -> str:
    """Parts that need ``checks`` come after the eigenvalues."""
    base = eigen_("redundancy diversity_without ep_dirs health ic", "") .rstrip() + f",\nn_eff AS {_N_EFF}"
    late = [n for n in ("checks", "penalty_inputs", "penalties", *names.split()) if n]
    return base + ",\n" + ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in dict.fromkeys(late)) + "\n" + body


@query(
    "candidate_checks",
    _after_checks(
        "",
        "SELECT factor_id, r_squared, is_redundant, diversity_before, diversity_after, cluster_warning, n_effective, n_total FROM checks",
    ),
)
def candidate_checks(spark, sf):
    return shaped(H.candidate_checks(snapshot(spark, sf).dropna(subset=B.FACTORS), B.FACTORS))


def penalty_inputs(spark, sf):
    """Every factor's checks as a candidate beside the others, its health and its score, all from its own values and series."""
    ic = daily(spark, sf)
    series = ic.groupBy(FACTOR).agg(F.count("ic").alias("n_ic"), F.abs(F.avg("ic")).alias("composite_score"))
    checks = H.candidate_checks(snapshot(spark, sf).dropna(subset=B.FACTORS), B.FACTORS)
    health = H.ic_health(ic).select(FACTOR, "health_score", "regime_change")
    return checks.join(health, FACTOR).join(series, FACTOR)


@query(
    "factor_penalties",
    _after_checks(
        "",
        """SELECT factor_id, round(total, 3) AS penalty, round(greatest(0.15, 1 - total), 3) AS multiplier, shrink AS n_eff_shrinkage,
        round(composite_score * greatest(0.15, 1 - total) * shrink, 6) AS rank_score FROM penalties""",
    ),
)
def factor_penalties(spark, sf):
    df = H.with_penalties(penalty_inputs(spark, sf))
    return shaped(df.select(FACTOR, "penalty", "multiplier", "n_eff_shrinkage", "rank_score"))


# --- series diagnostics ----------------------------------------------------
part(
    "centred",
    ["ic"],
    """SELECT factor_id, row_number() OVER (PARTITION BY factor_id ORDER BY date) AS i, count(*) OVER (PARTITION BY factor_id) AS n,
       ic - avg(ic) OVER (PARTITION BY factor_id) AS x FROM ic""",
)
part(
    "acf",
    ["centred"],
    """SELECT a.factor_id, k, coalesce(sum(a.x * b.x), 0) / (any_value(v) + 1e-12) AS ac FROM (SELECT *, unnest(range(1, 41)) AS k FROM centred) a
       LEFT JOIN centred b ON b.factor_id = a.factor_id AND b.i = a.i - k
       JOIN (SELECT factor_id, sum(x * x) AS v FROM centred GROUP BY 1) t ON t.factor_id = a.factor_id GROUP BY a.factor_id, k""",
)
part(
    "halflife",
    ["acf"],
    """SELECT factor_id, coalesce(min(k) FILTER (WHERE k < 40 AND ac < th), 40) AS halflife FROM (SELECT *, CASE WHEN max(ac) FILTER (WHERE k = 1) OVER f > 0
       THEN 0.5 * max(ac) FILTER (WHERE k = 1) OVER f ELSE 0.05 END AS th FROM acf WINDOW f AS (PARTITION BY factor_id)) GROUP BY factor_id""",
)


@query(
    "ic_autocorrelation",
    with_(
        "acf halflife",
        f"""SELECT factor_id, any_value(halflife) AS halflife, greatest(3, any_value(halflife)) AS suggested_rebalance,
        {', '.join(f'round(max(ac) FILTER (WHERE k = {k}), 4) AS ac_{k}' for k in D.REPORTED_LAGS)}
        FROM acf JOIN halflife USING (factor_id) GROUP BY factor_id""",
    ),
)
def ic_autocorrelation(spark, sf):
    return shaped(D.autocorrelation(daily(spark, sf)))


part(
    "dft",
    ["centred"],
    """SELECT factor_id, n, k, 2.0 / n * sqrt(sum(x * cos(2 * pi() * k * i / n)) ** 2 + sum(x * sin(2 * pi() * k * i / n)) ** 2) AS power
       FROM (SELECT *, unnest(range(1, n // 2)) AS k FROM centred) WHERE k / n > 1 / 120.0 AND k / n < 0.5 GROUP BY factor_id, n, k""",
)


@query(
    "ic_spectrum",
    with_("dft", "SELECT factor_id, k, round(power, 6) AS power FROM dft"),
)
def ic_spectrum(spark, sf):
    return shaped(D.spectrum(daily(spark, sf)).select(FACTOR, "k", "power"))


@query(
    "dominant_periods",
    with_(
        "dft",
        f"""SELECT factor_id, {', '.join(f'max(p) FILTER (WHERE rn = {i}) AS period_{i}, max(round(power, 6)) FILTER (WHERE rn = {i}) AS power_{i}' for i in (1, 2, 3))},
        round(max(p) FILTER (WHERE rn = 1), 0) AS dominant_period, greatest(3, least(20, CAST(floor(max(p) FILTER (WHERE rn = 1) / 2) AS BIGINT))) AS suggested_hold
        FROM (SELECT *, round(n / k, 1) AS p, row_number() OVER (PARTITION BY factor_id ORDER BY power DESC, k DESC) AS rn FROM dft) GROUP BY factor_id""",
    ),
)
def dominant_periods(spark, sf):
    return shaped(D.dominant_periods(daily(spark, sf)))


_LAGS = ", ".join(
    f"({scale}, {first + j}, {float(w)!r})" for scale in D.SCALES for first, weights in [D.morlet_weights(scale)] for j, w in enumerate(weights) if w
)
part(
    "waves",
    ["ic"],
    f"""SELECT factor_id, scale, avg(e) FILTER (WHERE i > n - 60) / (avg(e) FILTER (WHERE i <= n - 60) + 1e-12) AS r FROM (
        SELECT b.factor_id, b.i, b.n, k.scale, abs(sum(k.w * a.ic)) AS e FROM days b CROSS JOIN kernel k
        JOIN days a ON a.factor_id = b.factor_id AND a.i = b.i - k.lag WHERE b.n >= 80 GROUP BY b.factor_id, b.i, b.n, k.scale)
        GROUP BY factor_id, scale""".replace(
        "days b", "(SELECT factor_id, ic, row_number() OVER (PARTITION BY factor_id ORDER BY date) AS i, count(*) OVER (PARTITION BY factor_id) AS n FROM ic) b"
    ).replace("days a", "(SELECT factor_id, ic, row_number() OVER (PARTITION BY factor_id ORDER BY date) AS i FROM ic) a").replace(
        "kernel k", f"(VALUES {_LAGS}) AS k(scale, lag, w)"
    ),
)


@query(
    "wavelet_health",
    with_(
        "waves",
        f"""SELECT factor_id, weak AS weakening_scales, CASE WHEN n = 0 THEN 'insufficient_data' WHEN weak >= n * 0.6 THEN 'degrading'
        WHEN weak >= n * 0.3 THEN 'caution' ELSE 'healthy' END AS overall FROM (
          SELECT f.factor_id, count(w.r) AS n, count(*) FILTER ((w.r - 1) * 100 < -30) AS weak FROM (SELECT DISTINCT factor_id FROM ic) f
          LEFT JOIN waves w USING (factor_id) GROUP BY f.factor_id)""",
    ),
)
def wavelet_health(spark, sf):
    """Recent against earlier wavelet energy; SQL adds up the same weights lag by lag."""
    return shaped(D.wavelet_health(daily(spark, sf)).drop("scales"))


_SHARES = [0.05, 0.1, 0.2, 0.3, 0.5]
part(
    "gaps",
    ["ic"],
    """SELECT factor_id, list(d ORDER BY d) AS d FROM (
         SELECT a.factor_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM pts a JOIN pts b ON b.factor_id = a.factor_id AND b.i > a.i
         WHERE a.n >= 315) GROUP BY factor_id""".replace(
        "pts a",
        "(SELECT * FROM (SELECT factor_id, ic AS x, lead(ic, 5) OVER w AS y, lead(ic, 10) OVER w AS z, row_number() OVER w AS i, count(*) OVER (PARTITION BY factor_id) AS n FROM ic WINDOW w AS (PARTITION BY factor_id ORDER BY date)) WHERE z IS NOT NULL) a",
    ).replace(
        "pts b",
        "(SELECT * FROM (SELECT factor_id, ic AS x, lead(ic, 5) OVER w AS y, lead(ic, 10) OVER w AS z, row_number() OVER w AS i FROM ic WINDOW w AS (PARTITION BY factor_id ORDER BY date)) WHERE z IS NOT NULL) b",
    ),
)
part(
    "dimension",
    ["gaps", "ic"],
    f"""SELECT factor_id, dim FROM (SELECT DISTINCT factor_id FROM ic) LEFT JOIN (
        SELECT factor_id, coalesce(avg((ln(share) - ln(before_share)) / (ln(r) - ln(before_r))) FILTER (WHERE ln(r) > ln(before_r)), 3.0) AS dim FROM (
          SELECT *, lag(r) OVER w AS before_r, lag(share) OVER w AS before_share FROM (
            SELECT factor_id, share, d[floor(share * (len(d) - 1))::BIGINT + 1] AS r FROM gaps, (VALUES {", ".join(f"({x}::DOUBLE)" for x in _SHARES)}) AS s(share)) WHERE r > 0
          WINDOW w AS (PARTITION BY factor_id ORDER BY share)) GROUP BY factor_id) USING (factor_id)""",
)
_DIM = "CASE WHEN dim IS NULL THEN 3.0 ELSE round(dim, 2) END"


@query(
    "phase_space_dimension",
    with_(
        "dimension",
        f"""SELECT factor_id, {_DIM} AS dimension, CASE WHEN dim IS NULL THEN 'insufficient_data' WHEN dim < 1.5 THEN 'periodic' WHEN dim < 2.0 THEN 'low_dim_chaos'
        WHEN dim < 2.5 THEN 'moderate_complexity' ELSE 'random' END AS verdict, coalesce(dim < 2.5, FALSE) AS predictable FROM dimension""",
    ),
)
def phase_space_dimension(spark, sf):
    """Growth of the share of close pairs; SQL sorts all pair distances, the operator counts them."""
    return shaped(D.phase_dimension(daily(spark, sf)))


@query(
    "full_diagnosis",
    with_(
        "waves dft halflife dimension ic",
        f"""SELECT f.factor_id, CASE WHEN weak >= n * 0.6 AND n > 0 THEN 'EXIT' WHEN weak >= n * 0.3 AND n > 0 THEN 'REDUCE' ELSE 'HOLD' END AS action,
        CASE WHEN n = 0 THEN 'insufficient_data' WHEN weak >= n * 0.6 THEN 'degrading' WHEN weak >= n * 0.3 THEN 'caution' ELSE 'healthy' END AS wavelet,
        weak AS weakening_scales, least(greatest(3, least(20, CAST(floor(p / 2) AS BIGINT))), greatest(3, halflife)) AS suggested_hold_days, halflife AS ic_halflife,
        round(p, 0) AS dominant_period, {_DIM} AS phase_dimension, coalesce(dim < 2.5, FALSE) AS predictable FROM (
          SELECT f.factor_id, count(w.r) AS n, count(*) FILTER ((w.r - 1) * 100 < -30) AS weak FROM (SELECT DISTINCT factor_id FROM ic) f
          LEFT JOIN waves w USING (factor_id) GROUP BY f.factor_id) f
        JOIN (SELECT factor_id, arg_max(round(n / k, 1), (power, k)) AS p FROM dft GROUP BY factor_id) USING (factor_id)
        JOIN halflife USING (factor_id) JOIN dimension USING (factor_id)""",
    ),
)
def full_diagnosis(spark, sf):
    return shaped(D.full_diagnosis(daily(spark, sf)))


_CROWDED = "n_stocks >= 30 AND ic IS NOT NULL QUALIFY count(*) OVER (PARTITION BY factor_id) >= 80"


@query("market_diagnostics", ORACLES["full_diagnosis"].replace("n_stocks >= 10 AND ic IS NOT NULL", _CROWDED))
def market_diagnostics(spark, sf):
    return shaped(RP.column_diagnostics(B.wide_inputs(spark, sf), B.FACTORS, width=B.width(spark, sf)))


# --- indicator report ------------------------------------------------------
from .series import _FEATURE_SQL  # noqa: E402

_REPORT = (
    _FEATURE_SQL.split("\nSELECT symbol")[0]
    + """,
feats AS (SELECT f.symbol, f.date, f.bar_no, rsi_14, bb_position, ma20_dist, least(greatest(0.35 * coalesce((50 - rsi_14) / 50, 0)
   + 0.35 * coalesce((0.5 - bb_position) * 2, 0) + 0.30 * coalesce(-ma20_dist / 0.10, 0), -1), 1) AS reversion_score,
   volume_ratio, squeeze_ratio, ret_5d, n, fwd FROM f JOIN (SELECT symbol, bar_no, lead(close, 5) OVER (PARTITION BY symbol ORDER BY bar_no)
   / close - 1 AS fwd FROM panel) USING (symbol, bar_no) WHERE n >= 60 AND bar_no > 60),
lng AS (SELECT * FROM ("""
    + " UNION ALL ".join(f"SELECT '{x}' AS factor_id, symbol, date, {x} AS value, fwd FROM feats" for x in RP.REPORTED)
    + f""") WHERE value IS NOT NULL AND fwd IS NOT NULL),
rk AS (SELECT *, {avg_rank('value', 'factor_id, date')} AS rv, {avg_rank('fwd', 'factor_id, date')} AS rf,
  count(*) OVER (PARTITION BY factor_id, date) AS nn, {qlabel('value', 'factor_id, date')} AS q FROM lng),
dic AS (SELECT factor_id, date, {corr('rv', 'rf')} AS ic FROM rk WHERE nn >= 10 GROUP BY factor_id, date),
qd AS (SELECT factor_id, date, {', '.join(f'avg(fwd) FILTER (WHERE q = {k}) AS q{k}' for k in range(1, 6))} FROM rk WHERE nn >= 25
  GROUP BY factor_id, date HAVING count(DISTINCT q) = 5)
SELECT factor_id, ic_mean, ic_ir, ic_positive_pct, n_days, coalesce(long_short_pct, 0) AS long_short_pct,
  coalesce(monotonicity, 0) AS monotonicity,
  CASE WHEN abs(ic_mean) > 0.02 AND abs(ic_ir) > 0.3 THEN 'pass' WHEN abs(ic_mean) > 0.02 OR abs(ic_ir) > 0.3 OR abs(monotonicity) > 0.7
  THEN 'partial' ELSE 'fail' END AS status FROM
 (SELECT factor_id, round(avg(ic), 4) AS ic_mean, round(avg(ic) / stddev_samp(ic), 3) AS ic_ir,
   round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END) * 100, 1) AS ic_positive_pct, count(ic) AS n_days FROM dic GROUP BY 1)
 LEFT JOIN (SELECT factor_id, round((q5 - q1) * 100, 3) AS long_short_pct, round({mono_sql()}, 3) AS monotonicity FROM
   (SELECT factor_id, {', '.join(f'avg(q{k}) AS q{k}' for k in range(1, 6))} FROM qd GROUP BY 1)) USING (factor_id)"""
)


@query("factor_report", _REPORT)
def factor_report(spark, sf):
    df = RP.factor_report(B.panel(spark, sf), width=B.width(spark, sf))
    return shaped(
        df.select(FACTOR, "ic_mean", "ic_ir", "ic_positive_pct", "n_days", "long_short_pct", "monotonicity", "status")
    )
