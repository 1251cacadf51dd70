"""Per-date operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.columns import DATE, SYMBOL
from sigloom.functions import cross as C, rolling as R
from sigloom.functions.scalar import ratio
from sigloom.plans.evaluate import compute_factor

from . import testbed as B
from .registry import query, shaped
from .sql import avg_rank, day, qlabel, with_

c = F.col


def _base(spark, sf):
    return B.wide_inputs(spark, sf).select(SYMBOL, DATE, "rev", "surge", "mom")


@query(
    "rank",
    with_(
        "wide",
        f"""SELECT symbol, {day('date')}, round(CASE WHEN surge IS NOT NULL THEN {avg_rank('surge', 'date')}
        / count(surge) OVER (PARTITION BY date) END, 6) AS rank FROM wide""",
    ),
)
def rank(spark, sf):
    df = C.with_ranks(_base(spark, sf), {"rank": "surge"})
    return shaped(df.select(SYMBOL, DATE, "rank"))


@query(
    "zscore",
    with_(
        "wide",
        f"""SELECT symbol, {day('date')}, round(CASE WHEN coalesce(stddev_samp(rev) OVER d, 0) = 0 THEN rev * 0
        ELSE (rev - avg(rev) OVER d) / stddev_samp(rev) OVER d END, 6) AS zscore FROM wide WINDOW d AS (PARTITION BY date)""",
    ),
)
def zscore(spark, sf):
    return shaped(C.with_zscores(_base(spark, sf), {"zscore": "rev"}).select(SYMBOL, DATE, "zscore"))


@query(
    "demean",
    with_("wide", f"SELECT symbol, {day('date')}, round(rev - avg(rev) OVER (PARTITION BY date), 6) AS demean FROM wide"),
)
def demean(spark, sf):
    return shaped(C.with_demeaned(_base(spark, sf), {"demean": "rev"}).select(SYMBOL, DATE, "demean"))


@query(
    "quintile",
    with_(
        "wide",
        f"""SELECT symbol, {day('date')}, {qlabel('mom', 'date')} AS quintile FROM wide WHERE mom IS NOT NULL
        QUALIFY count(*) OVER (PARTITION BY date) >= 25""",
    ),
)
def quintile(spark, sf):
    df = C.with_quantiles(_base(spark, sf).where(c("mom").isNotNull()), "mom", "quintile", 5)
    crowd = df.groupBy(DATE).count().where(c("count") >= 25).select(DATE)
    return shaped(df.join(F.broadcast(crowd), DATE, "left_semi").select(SYMBOL, DATE, "quintile"))


@query(
    "quantile",
    with_(
        "wide",
        f"""SELECT symbol, {day('date')}, 1 + CAST(mom > q[1] AS INT) + CAST(mom > q[2] AS INT) AS tercile
        FROM (SELECT *, quantile_cont(mom, [1/3, 2/3]) OVER (PARTITION BY date) AS q FROM wide WHERE mom IS NOT NULL)""",
    ),
)
def quantile(spark, sf):
    df = C.with_quantiles(_base(spark, sf).where(c("mom").isNotNull()), "mom", "tercile", 3)
    return shaped(df.select(SYMBOL, DATE, "tercile"))


@query(
    "neutralize",
    with_(
        "wide",
        f"""SELECT w.symbol, {day('w.date', 'date')}, round(rev - avg(rev) OVER (PARTITION BY date, s_nationkey), 6) AS neutral
        FROM wide w JOIN supplier ON CAST(s_suppkey AS VARCHAR) = w.symbol""",
    ),
)
def neutralize(spark, sf):
    groups = B.table(spark, sf, "supplier").select(c("s_suppkey").cast("string").alias(SYMBOL), "s_nationkey")
    df = _base(spark, sf).join(groups, SYMBOL)
    return shaped(C.with_neutralized(df, "rev", "s_nationkey", "neutral").select(SYMBOL, DATE, "neutral"))


# --- composed factors ------------------------------------------------------
@query(
    "compute_factor",
    with_(
        "wide",
        f"""SELECT symbol, {day('date')}, round(a * b, 10) AS factor_value FROM (SELECT *,
        CASE WHEN vpdiv IS NOT NULL THEN {avg_rank('vpdiv', 'date')} / count(vpdiv) OVER (PARTITION BY date) END AS a,
        CASE WHEN rev IS NOT NULL THEN {avg_rank('rev', 'date')} / count(rev) OVER (PARTITION BY date) END AS b FROM wide)""",
    ),
)
def composed(spark, sf):
    df = compute_factor(B.featured(spark, sf), "rank(-ts_corr(close, volume, 20)) * rank(-ret_5d)")
    return shaped(df, 10)


@query(
    "nested_factor",
    with_(
        "wide",
        f"""SELECT symbol, {day('date')}, round(CASE WHEN count(r) OVER w = 5 THEN avg(r) OVER w END, 6) AS factor_value
        FROM (SELECT *, {avg_rank('close', 'date')} / count(close) OVER (PARTITION BY date) AS r FROM wide)
        WINDOW w AS (PARTITION BY symbol ORDER BY bar_no ROWS 4 PRECEDING)""",
    ),
)
def nested(spark, sf):
    """A rolling mean over a cross-sectional rank: symbol windows after a date window."""
    return shaped(compute_factor(B.featured(spark, sf), "ts_mean(rank(close), 5)"))


@query(
    "directed_top_share",
    with_(
        "wide",
        f"""SELECT symbol, {day('date')}, CASE WHEN pct >= 1 - 10.0 / n THEN round(pct, 4) ELSE 0 END AS score FROM (SELECT symbol, date,
        (count(*) OVER (PARTITION BY date) + 1 - {avg_rank('mom', 'date')}) / count(*) OVER (PARTITION BY date) AS pct,
        count(*) OVER (PARTITION BY date) AS n FROM wide WHERE mom IS NOT NULL)""",
    ),
)
def directed_top_share(spark, sf):
    from sigloom.operators.selection import pick_scores

    df = _base(spark, sf).select(SYMBOL, DATE, c("mom").alias("value"), F.date_format(DATE, "yyyy-MM-dd").alias("factor_id"))
    scored = pick_scores(df, F.lit("bot"), 10, B.width(spark, sf))
    return shaped(scored.select(SYMBOL, DATE, "score"))
