"""Promotion gates, mining gates, scores and attrition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..columns import FACTOR

c = F.col

# Promotion thresholds per market.
MARKET_GATES = {
    "cn": {"ic": 0.01, "ic_ir": 0.2, "turnover": 0.50, "monotonicity": 0.0, "correlation": 0.6},
    "us": {"ic": 0.02, "ic_ir": 0.3, "turnover": 0.40, "monotonicity": 0.7, "correlation": 0.6},
}
COLLINEARITY_LIMIT = 0.85

# Looser thresholds while mining.
MINING_GATES = {
    "cn": {"ic": 0.015, "ic_ir": 0.15, "mono": 0.0},
    "us": {"ic": 0.02, "ic_ir": 0.2, "mono": 0.6},
}

# Formula fragments that only proxy size or liquidity.
BLOCKED_FRAGMENTS = [
    "rank(volume)",
    "rank(-volume)",
    "rank(ts_mean(volume,",
    "rank(-ts_mean(volume,",
    "rank(ts_std(volume,",
    "rank(-ts_std(volume,",
    "rank(volume/ts_mean(volume,",
    "rank(-volume/ts_mean(volume,",
    "rank(amount)",
    "rank(-amount)",
    "rank(ts_mean(amount,",
    "rank(-ts_mean(amount,",
    "rank(ts_std(amount,",
    "rank(-ts_std(amount,",
    "abs(ret_1d)/(volume",
    "abs(ret_1d)/(amount",
]

GATE_NAMES = ["ic", "ic_ir", "turnover", "monotonicity", "correlation", "multi_collinearity"]


def _gates(market: str, n_existing: Column) -> dict[str, tuple[Column, Column, float]]:
    """gate → (value, passed, threshold) over averaged walk-forward metrics."""
    t = MARKET_GATES[market]
    corr = F.when(n_existing > 0, F.coalesce("max_corr", F.lit(0.0))).otherwise(0.0)
    r2 = F.when(n_existing >= 3, F.coalesce("r_squared", F.lit(0.0))).otherwise(0.0)
    return {
        "ic": (F.round("avg_ic", 4), F.abs("avg_ic") >= t["ic"], t["ic"]),
        "ic_ir": (F.round("avg_ic_ir", 3), c("avg_ic_ir") >= t["ic_ir"], t["ic_ir"]),
        "turnover": (F.round("avg_turnover", 4), c("avg_turnover") <= t["turnover"], t["turnover"]),
        "monotonicity": (
            F.round("avg_monotonicity", 3), F.abs("avg_monotonicity") >= t["monotonicity"], t["monotonicity"],
        ),
        "correlation": (F.round(corr, 3), corr < t["correlation"], t["correlation"]),
        "multi_collinearity": (r2, r2 <= COLLINEARITY_LIMIT, COLLINEARITY_LIMIT),
    }


def check_gates(metrics: DataFrame, market: str) -> DataFrame:
    """Long rows (factor, gate, passed, value, threshold).

    ``metrics``: walk-forward averages plus max_corr, r_squared and n_existing
    against the factors already promoted.
    """
    rows = [
        F.struct(
            F.lit(g).alias("gate"), ok.alias("passed"), value.cast("double").alias("value"),
            F.lit(limit).alias("threshold"),
        )
        for g, (value, ok, limit) in _gates(market, c("n_existing")).items()
    ]
    return metrics.select(FACTOR, F.inline(F.array(*rows)))


def gate_verdict(metrics: DataFrame, market: str) -> DataFrame:
    """``passed`` over all gates and a map gate → {passed, value, threshold}."""
    gates = _gates(market, c("n_existing"))
    passed = reduce(lambda a, b: a & b, [ok for _, ok, _ in gates.values()])
    detail = F.create_map(
        *[
            x
            for g, (value, ok, limit) in gates.items()
            for x in (
                F.lit(g),
                F.struct(ok.alias("passed"), value.cast("double").alias("value"), F.lit(limit).alias("threshold")),
            )
        ]
    )
    return metrics.withColumns({"passed": passed, "gates": detail})


def blacklisted(formula: Column) -> Column:
    bare = F.replace(formula, F.lit(" "), F.lit(""))
    return reduce(lambda a, b: a | b, [bare.contains(p) for p in BLOCKED_FRAGMENTS])


def mining_score(ic: Column, ir: Column, mono: Column) -> Column:
    """abs(ic)*abs(ir), negative where ic and monotonicity disagree in sign."""
    return F.abs(ic) * F.abs(ir) * F.when(ic * mono >= 0, 1).otherwise(-1)


def mining_gates(market: str) -> dict[str, Column]:
    """Cascade of conditions over ic, ic_ir, mono: each name includes the ones before."""
    t = MINING_GATES[market]
    ic = F.abs("ic") >= t["ic"]
    ir = ic & (F.abs("ic_ir") >= t["ic_ir"])
    return {"ic": ic, "ic_ir": ir, "all": ir & (F.abs("mono") >= t["mono"])}


def attrition(candidates: DataFrame, market: str) -> DataFrame:
    gates = mining_gates(market)
    return candidates.agg(
        F.count(F.lit(1)).alias("valid"),
        F.count_if(gates["ic"]).alias("ic"),
        F.count_if(gates["ic_ir"]).alias("ic_ir"),
        F.count_if(gates["all"]).alias("passed"),
    )


def best_candidates(candidates: DataFrame, n: int = 30) -> DataFrame:
    return candidates.orderBy(F.desc("score"), FACTOR).limit(n)


def oos_finalists(candidates: DataFrame, n: int = 3) -> DataFrame:
    """Gate-passers with the strongest in-sample ic."""
    return candidates.where("passed").orderBy(F.abs("ic").desc(), FACTOR).limit(n)


def first_per_formula(candidates: DataFrame, order: str) -> DataFrame:
    """Keep the first row per formula by ``order``; combined map-side, no window."""
    cols = [x for x in candidates.columns if x != "formula"]
    best = candidates.groupBy("formula").agg(F.min_by(F.struct(*cols), c(order)).alias("_b"))
    return best.select("formula", "_b.*").select(*candidates.columns)
