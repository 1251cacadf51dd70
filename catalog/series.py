"""Per-symbol operators and element-wise scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.columns import BAR, DATE, SYMBOL
from sigloom.functions import rolling as R, scalar as S
from sigloom.operators import indicators as I, panel as P

from . import testbed as B
from .registry import query, shaped
from .sql import day, with_

c = F.col


def _window_sql(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY bar_no ROWS {n - 1} PRECEDING)"


def _full(x: str, n: int, body: str) -> str:
    return f"CASE WHEN count({x}) {_window_sql(n)} = {n} THEN {body} END"


def _series(name, build, expr, digits=6, source="featured"):
    """Register one rolling operator: symbol, date and the value under the operator's name."""
    sql = with_(source, f"SELECT symbol, {day('date')}, round({expr}, {digits}) AS {name} FROM {source}")

    @query(name, sql)
    def run(spark, sf):
        df = B.featured(spark, sf)
        return shaped(df.select(SYMBOL, DATE, build().cast("double").alias(name)), digits)


W20, W10 = _window_sql(20), _window_sql(10)

_series("ts_mean", lambda: R.ts_mean(c("close"), 10), _full("close", 10, f"avg(close) {W10}"), 4)
_series("ts_std", lambda: R.ts_std(c("ret_1d"), 20), _full("ret_1d", 20, f"stddev_samp(ret_1d) {W20}"))
_series("ts_max", lambda: R.ts_max(c("high"), 20), _full("high", 20, f"max(high) {W20}"), 7)
_series("ts_min", lambda: R.ts_min(c("low"), 20), _full("low", 20, f"min(low) {W20}"), 7)
_series("ts_sum", lambda: R.ts_sum(c("volume"), 10), _full("volume", 10, f"sum(volume) {W10}"), 4)
_series(
    "ts_rank",
    lambda: R.ts_rank(c("ret_1d"), 10),
    _full("ret_1d", 10, f"len(list_filter(list(ret_1d) {W10}, lambda v: v < ret_1d)) / 9.0"),
)
_series(
    "ts_argmax",
    lambda: R.ts_argmax(c("volume"), 10),
    _full("volume", 10, f"(10 - list_position(list(volume) {W10}, max(volume) {W10}))::DOUBLE"),
)
_series(
    "ts_argmin",
    lambda: R.ts_argmin(c("volume"), 10),
    _full("volume", 10, f"(10 - list_position(list(volume) {W10}, min(volume) {W10}))::DOUBLE"),
)
_series(
    "ts_corr",
    lambda: R.ts_corr(c("close"), c("volume"), 20),
    _full("close + volume", 20, f"CASE WHEN isnan(corr(close, volume) {W20}) THEN NULL ELSE corr(close, volume) {W20} END"),
)
_series(
    "ts_cov",
    lambda: R.ts_cov(c("ret_1d"), c("volume"), 20),
    _full("ret_1d + volume", 20, f"covar_samp(ret_1d, volume) {W20}"),
    4,
)
_series("ts_count", lambda: R.ts_count(c("ret_1d"), 20), f"(count(*) FILTER (WHERE ret_1d > 0) {W20})::DOUBLE")
_series(
    "ts_skew",
    lambda: R.ts_skew(c("ret_1d"), 20),
    _full("ret_1d", 20, f"coalesce(skewness(ret_1d) {W20}, 0)"),
)
_series(
    "ts_kurt",
    lambda: R.ts_kurt(c("ret_1d"), 20),
    _full("ret_1d", 20, f"coalesce(kurtosis(ret_1d) {W20}, -3)"),
)
_series(
    "ts_product",
    lambda: R.ts_product(c("ret_1d") + 1, 5),
    _full("ret_1d", 5, f"list_product(list(ret_1d + 1) {_window_sql(5)})"),
    4,
)
_LAGS = "OVER (PARTITION BY symbol ORDER BY bar_no)"
_series("delta", lambda: R.delta(c("close"), 5), f"close - lag(close, 5) {_LAGS}", 7)
_series("pct_change", lambda: R.pct_change(c("close"), 5), f"close / nullif(lag(close, 5) {_LAGS}, 0) - 1")
_series("shift", lambda: R.shift(c("close"), 3), f"lag(close, 3) {_LAGS}", 7)
_series(
    "decay_linear",
    lambda: R.decay_linear(c("ret_1d"), 10),
    _full("ret_1d", 10, f"list_sum(list_transform(list(ret_1d) {W10}, lambda v, i: v * i)) / 55.0"),
)
_series(
    "decay_exp",
    lambda: R.decay_exp(c("ret_1d"), 10),
    f"""CASE WHEN count(ret_1d) OVER (PARTITION BY symbol ORDER BY bar_no) >= 10
        THEN sum(ret_1d * pow(2.0, bar_no / 10.0)) OVER (PARTITION BY symbol ORDER BY bar_no)
           / sum(CASE WHEN ret_1d IS NOT NULL THEN pow(2.0, bar_no / 10.0) END) OVER (PARTITION BY symbol ORDER BY bar_no) END""",
)

# --- element-wise ----------------------------------------------------------
_series("abs", lambda: S.absolute(c("ret_1d")), "abs(ret_1d)")
_series("sign", lambda: S.sign(c("ret_1d")), "sign(ret_1d)::DOUBLE")
_series("log", lambda: S.log(c("ret_5d")), "CASE WHEN ret_5d > 0 THEN ln(ret_5d) END")
_series("sqrt", lambda: S.sqrt(c("ret_5d")), "CASE WHEN ret_5d >= 0 THEN sqrt(ret_5d) END")
_series("power", lambda: S.power(c("ret_5d"), 0.5), "CASE WHEN ret_5d >= 0 THEN pow(ret_5d, 0.5) END")
_series("clamp", lambda: S.clamp(c("ret_5d"), -0.5, 0.5), "CASE WHEN ret_5d IS NOT NULL THEN least(greatest(ret_5d, -0.5), 0.5) END")
_series("elementwise_max", lambda: S.larger(c("ret_1d"), c("ret_5d")), "greatest(ret_1d, ret_5d)")
_series("elementwise_min", lambda: S.smaller(c("ret_1d"), c("ret_20d")), "least(ret_1d, ret_20d)")
_series("if_then", lambda: S.if_then(c("ret_1d"), c("high"), c("low")), "CASE WHEN ret_1d > 0 THEN high ELSE low END", 7)
_series("arithmetic", lambda: -(c("close") - c("open")) * c("ret_1d") + c("high"), "-(close - open) * ret_1d + high", 7)
_series(
    "divide",
    lambda: S.ratio(c("close") - c("open"), c("high") - c("low")),
    "(close - open) / nullif(high - low, 0)",
)


@query(
    "key_and_text_scalars",
    with_(
        "trades",
        """SELECT DISTINCT p_name AS name, substr(sha256('us:' || p_name), 1, 16) AS formula_key,
           'us_' || substr(sha1(p_name), 1, 12) AS factor_id,
           trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part""",
    ),
)
def key_and_text_scalars(spark, sf):
    part = B.table(spark, sf, "part").select(c("p_name").alias("name")).distinct()
    return part.select(
        "name",
        S.formula_key(F.lit("us"), c("name")).alias("formula_key"),
        S.stable_factor_id(F.lit("us"), c("name")).alias("factor_id"),
        S.slug(c("name")).alias("slug"),
    )


# --- helpers outside the factor language -----------------------------------
@query(
    "forward_returns",
    with_(
        "panel",
        f"""SELECT symbol, {day('date')}, round(close, 7) AS close,
        {', '.join(f'round(lead(close, {h}) OVER w / close - 1, 6) AS fwd_{h}' for h in (1, 5, 10, 20))}
        FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY bar_no)""",
    ),
)
def forward_returns(spark, sf):
    df = P.with_forward_returns(B.panel(spark, sf), (1, 5, 10, 20))
    return shaped(df.select(SYMBOL, DATE, "close", "fwd_1", "fwd_5", "fwd_10", "fwd_20"), close=7)


@query(
    "backward_returns",
    with_(
        "featured",
        f"SELECT symbol, {day('date')}, round(ret_1d, 6) AS ret_1d, round(ret_5d, 6) AS ret_5d, round(ret_20d, 6) AS ret_20d FROM featured",
    ),
)
def backward_returns(spark, sf):
    return shaped(B.featured(spark, sf).select(SYMBOL, DATE, "ret_1d", "ret_5d", "ret_20d"))


_series("volume_ratio_with_today", lambda: c("volume_ratio"), "volume_ratio")
_PREV20 = "OVER (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
_series(
    "volume_ratio_previous",
    lambda: I.volume_ratio(),
    f"CASE WHEN bar_no > 20 THEN volume / nullif(avg(volume) {_PREV20}, 0) END",
)
_series("vwap", lambda: c("vwap") / c("close"), "vwap / close")


# RSI by explicit recursion over each symbol's moves
_RSI = """moves AS (SELECT symbol, date, bar_no, greatest(close - lag(close) OVER w, 0) AS gain,
    greatest(lag(close) OVER w - close, 0) AS loss FROM featured WINDOW w AS (PARTITION BY symbol ORDER BY bar_no)),
seed AS (SELECT symbol, avg(gain) AS g, avg(loss) AS l FROM moves WHERE bar_no BETWEEN 2 AND 15 GROUP BY symbol HAVING count(*) = 14),
wilder AS (
  SELECT symbol, CAST(15 AS BIGINT) AS bar_no, g, l FROM seed
  UNION ALL
  SELECT m.symbol, m.bar_no, (w.g * 13 + m.gain) / 14, (w.l * 13 + m.loss) / 14
  FROM wilder w JOIN moves m ON m.symbol = w.symbol AND m.bar_no = w.bar_no + 1),
rsi AS (SELECT symbol, bar_no, CASE WHEN l >= 1e-10 THEN 100 - 100 / (1 + g / l) END AS rsi_14 FROM wilder WHERE bar_no > 15)"""


@query(
    "rsi",
    with_("featured", "").replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    + ",\n" + _RSI
    + f"\nSELECT f.symbol, {day('f.date', 'date')}, round(r.rsi_14, 6) AS rsi_14 FROM featured f LEFT JOIN rsi r USING (symbol, bar_no)",
)
def rsi(spark, sf):
    return shaped(B.panel(spark, sf).select(SYMBOL, DATE, I.rsi().alias("rsi_14")))


_BB = f"(close - (avg(close) {W20} - 2 * stddev_pop(close) {W20})) / (4 * stddev_pop(close) {W20})"
_series(
    "bollinger_position",
    lambda: I.bollinger_position(),
    f"CASE WHEN bar_no > 20 THEN CASE WHEN stddev_pop(close) {W20} < 1e-10 THEN 0.5 ELSE least(greatest({_BB}, 0), 1) END END",
)
_series(
    "ma_distance",
    lambda: I.ma_distance(20),
    f"CASE WHEN bar_no > 20 THEN (close - avg(close) {W20}) / nullif(avg(close) {W20}, 0) END",
)

_PREV = "OVER (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN {a} PRECEDING AND 1 PRECEDING)"
_LR = """logret AS (SELECT *, ln(close) - lag(ln(close)) OVER w AS lr,
 lag(ln(close)) OVER w - lag(ln(close), 2) OVER w AS lr1 FROM featured WINDOW w AS (PARTITION BY symbol ORDER BY bar_no))"""
_REGIME = f"""regimes AS (SELECT *, CASE WHEN bar_no >= 22 THEN {{c}} END AS ac FROM logret)""".format(
    c="CASE WHEN isnan(corr(lr1, lr) {w}) THEN NULL ELSE corr(lr1, lr) {w} END".format(w=_PREV.format(a=19))
)
_REGIME_CASE = "CASE WHEN ac > 0.15 THEN 0.0 WHEN ac < -0.10 THEN 1.0 ELSE 2.0 END"


@query(
    "regime",
    with_("featured", "").rstrip() + f",\n{_LR},\n{_REGIME}\nSELECT symbol, {day('date')}, ({_REGIME_CASE})::DOUBLE AS regime FROM regimes",
)
def regime(spark, sf):
    df = I.with_log_returns(B.panel(spark, sf))
    return shaped(df.select(SYMBOL, DATE, I.regime().alias("regime")))


_SQ = "CASE WHEN bar_no >= 62 THEN stddev_pop(lr) {a} / nullif(stddev_pop(lr) {b}, 0) END".format(
    a=_PREV.format(a=20), b=_PREV.format(a=60)
)


@query(
    "squeeze",
    with_("featured", "").rstrip() + f",\n{_LR}\nSELECT symbol, {day('date')}, round({_SQ}, 6) AS squeeze_ratio FROM logret",
)
def squeeze(spark, sf):
    df = I.with_log_returns(B.panel(spark, sf))
    return shaped(df.select(SYMBOL, DATE, I.squeeze().alias("squeeze_ratio")))


_FEATURE_SQL = (
    with_("featured", "").replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    + f""",
{_RSI},
{_LR},
{_REGIME},
f AS (SELECT g.symbol, g.date, g.bar_no, r.rsi_14,
  CASE WHEN stddev_pop(close) {W20} < 1e-10 THEN 0.5 ELSE least(greatest({_BB}, 0), 1) END AS bb_position,
  (close - avg(close) {W20}) / nullif(avg(close) {W20}, 0) AS ma20_dist,
  {_REGIME_CASE} AS regime,
  volume / nullif(avg(volume) {_PREV20}, 0) AS volume_ratio, {_SQ} AS squeeze_ratio, ret_5d,
  count(*) OVER (PARTITION BY symbol) AS n
  FROM regimes g LEFT JOIN rsi r USING (symbol, bar_no))
SELECT symbol, {day('date')}, round(rsi_14, 6) AS rsi_14, round(bb_position, 6) AS bb_position, round(ma20_dist, 6) AS ma20_dist,
  round(least(greatest(0.35 * coalesce((50 - rsi_14) / 50, 0) + 0.35 * coalesce((0.5 - bb_position) * 2, 0)
   + 0.30 * coalesce(-ma20_dist / 0.10, 0), -1), 1), 6) AS reversion_score,
  regime::DOUBLE AS regime, round(volume_ratio, 6) AS volume_ratio, round(squeeze_ratio, 6) AS squeeze_ratio, round(ret_5d, 6) AS ret_5d
FROM f WHERE n >= 60 AND bar_no > 60"""
)


@query("feature_table", _FEATURE_SQL)
def feature_table(spark, sf):
    return shaped(I.feature_table(B.panel(spark, sf)))


@query(
    "reversion_score",
    _FEATURE_SQL.split("\nSELECT symbol")[0]
    + f"""\nSELECT symbol, {day('date')}, round(least(greatest(0.35 * coalesce((50 - rsi_14) / 50, 0) + 0.35 * coalesce((0.5 - bb_position) * 2, 0)
   + 0.30 * coalesce(-ma20_dist / 0.10, 0), -1), 1), 6) AS reversion_score FROM f WHERE n >= 60 AND bar_no > 60""",
)
def reversion_score(spark, sf):
    return shaped(I.feature_table(B.panel(spark, sf)).select(SYMBOL, DATE, "reversion_score"))


@query(
    "basic_features",
    with_(
        "featured",
        f"""SELECT symbol, {day('date')}, round(close, 7) AS close, round(volume, 4) AS volume, round(ret_1d, 6) AS ret_1d,
        round(ret_5d, 6) AS ret_5d, round(ret_20d, 6) AS ret_20d,
        round(volume / nullif(avg(volume) {_PREV20}, 0), 6) AS volume_ratio
        FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM featured) QUALIFY n >= 60 AND bar_no > 20""",
    ),
)
def basic_features(spark, sf):
    return shaped(I.basic_features(B.panel(spark, sf)), close=7, volume=4)


_TR = """tr AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS true_range
 FROM featured WINDOW w AS (PARTITION BY symbol ORDER BY bar_no))"""


@query(
    "average_true_range",
    with_("featured", "").rstrip()
    + f""",\n{_TR}\nSELECT symbol, {day('date')}, round(true_range, 7) AS true_range,
     round(CASE WHEN count(true_range) {_window_sql(14)} >= 5 THEN avg(true_range) {_window_sql(14)} END, 4) AS atr_14 FROM tr""",
)
def average_true_range(spark, sf):
    df = I.with_atr(B.panel(spark, sf))
    return shaped(df.select(SYMBOL, DATE, "true_range", "atr_14"), 4, true_range=7)
