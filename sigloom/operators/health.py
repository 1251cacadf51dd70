"""Normality, health, diversity and collinearity checks of factors, and the penalties they earn."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..columns import DATE, FACTOR, SYMBOL
from ..functions.scalar import ratio
from . import moments as MO

c = F.col

T_GRID = [0.1 + i * (3.0 - 0.1) / 19 for i in range(20)]


def _distance(n: Column, z: Column, over=None) -> Column:
    """n·mean over the grid of |ecf(t) - exp(-t²/2)|²·exp(-t²/2), as aggregates of z."""
    total = F.lit(0.0)
    for t in T_GRID:
        normal = float(np.exp(-t * t / 2))
        re, im = F.avg(F.cos(z * t)), F.avg(F.sin(z * t))
        total = total + (F.pow(re - normal, F.lit(2.0)) + F.pow(im, F.lit(2.0))) * normal
    return n * total / len(T_GRID)


def epps_pulley(df: DataFrame, by: list[str], value: str, out: str = "ep") -> DataFrame:
    """Distance from normality per group: 0 under 10 values, 999 when constant.

    Moments and characteristic functions are two map-side aggregates; the
    moments come back as one row per group.
    """
    x = c(value)
    stats = df.groupBy(*by).agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    z = ratio(x - c("_m"), c("_s"))
    n = F.count(x)
    agg = df.where(x.isNotNull()).join(stats, by).groupBy(*by).agg(
        n.alias("_n"), F.max("_s").alias("_sd"), _distance(n, z).alias("_d")
    )
    ep = F.when(c("_n") < 10, 0.0).when(c("_sd") < 1e-12, 999.0).otherwise(c("_d"))
    return agg.select(*by, ep.alias(out))


def ic_health(daily: DataFrame, window: int | None = None, by=(FACTOR,)) -> DataFrame:
    """Recent against full IC series: health score and regime change per factor.

    ``window`` None takes half the series, between 20 and 60 days, and needs 20.
    """
    by = list(by)
    newest = Window.partitionBy(*by).orderBy(F.desc(DATE))
    whole = Window.partitionBy(*by)
    span = F.lit(window) if window else F.least(F.lit(60), F.greatest(F.lit(20), F.floor(c("_n") / 2)))
    series = (
        daily.where(c("ic").isNotNull())
        .withColumns({"_rn": F.row_number().over(newest), "_n": F.count(F.lit(1)).over(whole)})
        .withColumn("_w", span)
    )
    enough = c("_n") >= F.greatest(c("_w"), F.lit(20))
    full = series.withColumn("part", F.lit("full"))
    both = full.unionByName(series.where(c("_rn") <= c("_w")).withColumn("part", F.lit("recent")))
    ep = epps_pulley(both, [*by, "part"], "ic").groupBy(*by).agg(
        F.max(F.when(c("part") == "recent", c("ep"))).alias("ep_recent"),
        F.max(F.when(c("part") == "full", c("ep"))).alias("ep_full"),
    )
    recent = F.when(c("_rn") <= c("_w"), c("ic"))
    stats = series.groupBy(*by).agg(
        F.avg(recent).alias("mr"), F.avg("ic").alias("mf"), F.stddev_pop("ic").alias("sf"),
        F.max(enough).alias("enough"), F.max("_w").alias("w"),
    )
    drift = F.abs(c("mr") - c("mf")) / (c("sf") / F.sqrt(c("w").cast("double")) + 1e-12)
    score = (
        F.when(c("mr") > 0, 0.4).otherwise(0.0)
        + F.when(c("ep_recent") < 1.0, 0.3).otherwise(0.0)
        + F.when(drift < 2.0, 0.3).otherwise(0.0)
    )
    change = (drift > 3.0) | ((c("ep_recent") > 2.0) & (c("ep_full") < 1.0))
    ok = c("enough")
    return stats.join(ep, by).select(
        *by,
        F.when(ok, F.round(score, 2)).otherwise(0.5).alias("health_score"),
        (ok & change).alias("regime_change"),
        F.when(ok, F.round("mr", 4)).alias("ic_mean_recent"),
        F.when(ok, F.round("mf", 4)).alias("ic_mean_full"),
        F.when(ok, F.round(drift, 2)).alias("drift_z"),
        F.when(ok, F.round("ep_recent", 3)).alias("ep_recent"),
        F.when(ok, F.round("ep_full", 3)).alias("ep_full"),
    )


def directions(k: int, n: int = 200, seed: int = 42) -> np.ndarray:
    """Unit directions of the random projections, fixed by the seed."""
    d = np.random.RandomState(seed).randn(n, k)
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def standardised(n: int, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Population deviations, and the covariances of the values divided by them."""
    sd = np.sqrt(np.clip(np.diag(cov), 0.0, None))
    return sd, cov / np.outer(sd + 1e-12, sd + 1e-12)


def effective_count(cov: np.ndarray) -> float:
    """exp(entropy) of the correlation eigenvalues above 0.01 (a k-by-k problem)."""
    d = np.sqrt(np.diag(cov))
    eig = np.linalg.eigvalsh(cov / np.outer(d, d))
    eig = eig[eig > 0.01]
    p = eig / eig.sum()
    return float(np.exp(-np.sum(p * np.log(p + 1e-12))))


DIVERSITY_SCHEMA = (
    "diversity_score double, n_effective double, n_total int, cluster_warning boolean, "
    "mean_ep double, ep_median double, ep_p95 double"
)


def factor_diversity(wide: DataFrame, factors: list[str], projections: int = 200, seed: int = 42) -> DataFrame:
    """How spread out a factor set is on one date (wide: one row per symbol); one row out."""
    return diversity_of_sets(wide, {"all": factors}, projections, seed).drop("name")


def diversity_of_sets(wide: DataFrame, sets: dict[str, list[str]], projections: int = 200, seed: int = 42) -> DataFrame:
    """``factor_diversity`` of several sets of factors at once: a row per named set, over rows that have all of them.

    One matrix of moments serves all sets. Each row is projected on every
    direction of every set and combined map-side into one group per set and
    direction, so nothing but those groups is shuffled.
    """
    spark = wide.sparkSession
    schema = f"name string, {DIVERSITY_SCHEMA}"
    few = [(x, 1.0, float(len(f)), len(f), False, None, None, None) for x, f in sets.items() if len(f) < 3]
    sets = {x: f for x, f in sets.items() if len(f) >= 3}
    factors = list(dict.fromkeys(f for own in sets.values() for f in own))
    if not sets:
        return spark.createDataFrame(few, schema)
    n, mean, covariances = MO.moment_matrix(wide, factors)
    if n < 50:
        return spark.createDataFrame(few + [(x, 0.5, float(len(f)), len(f), False, None, None, None) for x, f in sets.items()], schema)
    sd, cov = standardised(n, covariances)
    table, facts = [], []
    for name, own in sets.items():
        at = [factors.index(f) for f in own]
        part = cov[np.ix_(at, at)]
        dirs = directions(len(own), projections, seed)
        spread = np.sqrt(np.einsum("dk,kl,dl->d", dirs, part, dirs))
        full = np.zeros((len(dirs), len(factors)))
        full[:, at] = dirs
        table += [(name, d.tolist(), float(s)) for d, s in zip(full, spread)]
        n_eff = effective_count(part)
        facts.append((name, round(n_eff, 1), len(own), bool(n_eff < len(own) * 0.5)))
    z = F.array(*[(c(f) - float(mean[i])) / float(sd[i] + 1e-12) for i, f in enumerate(factors)])
    rows = wide.dropna(subset=factors)
    dot = F.aggregate(F.zip_with("z", "d", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    every = F.inline(F.array(*[F.struct(F.lit(x).alias("name"), F.lit(d).alias("d"), F.lit(s).alias("sd"), F.lit(i).alias("direction")) for i, (x, d, s) in enumerate(table)]))
    projected = rows.select(z.alias("z"), every).select("name", "direction", "sd", dot.alias("p"))
    per_direction = projected.groupBy("name", "direction").agg(
        F.max("sd").alias("sd"), _distance(F.count(F.lit(1)), ratio(c("p"), c("sd"))).alias("d")
    ).select("name", F.when(c("sd") < 1e-12, 999.0).otherwise(c("d")).alias("ep"))
    scores = per_direction.groupBy("name").agg(
        F.avg("ep").alias("m"), F.percentile("ep", F.lit(0.5)).alias("p50"), F.percentile("ep", F.lit(0.95)).alias("p95")
    )
    facts = spark.createDataFrame(facts, "name string, n_effective double, n_total int, cluster_warning boolean")
    out = scores.join(facts, "name").select(
        "name",
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - c("m") / 2.0)), 3).alias("diversity_score"),
        "n_effective", "n_total", "cluster_warning",
        F.round("m", 3).alias("mean_ep"), F.round("p50", 3).alias("ep_median"), F.round("p95", 3).alias("ep_p95"),
    )
    return out.unionByName(spark.createDataFrame(few, schema)) if few else out


COLLINEARITY_SCHEMA = f"{FACTOR} string, r_squared double, is_redundant boolean, top array<struct<factor:string,beta:double>>"


def _regressed(cov: np.ndarray, i: int) -> tuple[float, np.ndarray]:
    """R² and coefficients of column i on all the others."""
    rest = np.arange(len(cov)) != i
    gram, cross = cov[np.ix_(rest, rest)], cov[rest, i]
    beta = np.linalg.lstsq(gram, cross, rcond=1e-12)[0]
    return (float((2 * beta @ cross - beta @ gram @ beta) / cov[i, i]) if cov[i, i] > 0 else 0.0), beta


def leave_one_out(cov: np.ndarray) -> list[tuple[float, np.ndarray]]:
    """R² and coefficients of every column on all the others, from one inverse.

    Where the matrix is close to singular the columns are solved one by one.
    """
    if len(cov) > 1 and np.diag(cov).min() > 0 and np.linalg.cond(cov) < 1e8:
        inverse = np.linalg.inv(cov)
        own = np.diag(inverse)
        return [(1 - 1 / (cov[i, i] * own[i]), np.delete(-inverse[i] / own[i], i)) for i in range(len(cov))]
    return [_regressed(cov, i) for i in range(len(cov))]


def _verdict(candidate: str, existing: list[str], r2: float, beta: np.ndarray, threshold: float) -> tuple:
    top = sorted(zip(existing, np.abs(beta)), key=lambda kv: -kv[1])[:3]
    return candidate, round(float(r2), 3), bool(r2 > threshold), [(f, round(float(b), 3)) for f, b in top]


def collinearity(wide: DataFrame, candidate: str, existing: list[str], threshold: float = 0.85) -> DataFrame:
    """R² of the candidate on all existing factors together, with the three largest coefficients.

    One matrix of moments in one job; the solve is k by k.
    """
    n, _, cov = MO.moment_matrix(wide, [candidate, *existing]) if existing else (0, None, None)
    if n < 50:
        return wide.sparkSession.createDataFrame([(candidate, 0.0, False, [])], COLLINEARITY_SCHEMA)
    r2, beta = _regressed(standardised(n, cov)[1], 0)
    return wide.sparkSession.createDataFrame([_verdict(candidate, existing, r2, beta, threshold)], COLLINEARITY_SCHEMA)


def collinearity_of_all(wide: DataFrame, factors: list[str], threshold: float = 0.85) -> DataFrame:
    """``collinearity`` of each factor against all the others: one job and one inverse, however many factors."""
    n, _, cov = MO.moment_matrix(wide, factors) if len(factors) > 1 else (0, None, None)
    if n < 50:
        rows = [(f, 0.0, False, []) for f in factors]
    else:
        solved = leave_one_out(standardised(n, cov)[1])
        rows = [_verdict(f, [x for x in factors if x != f], r2, beta, threshold) for f, (r2, beta) in zip(factors, solved)]
    return wide.sparkSession.createDataFrame(rows, COLLINEARITY_SCHEMA)


def candidate_checks(wide: DataFrame, factors: list[str], promoted: list[str] | None = None) -> DataFrame:
    """What the penalties need about each factor as a candidate beside the ``promoted`` ones (None: all the others), on one date.

    (factor_id, r_squared, is_redundant, diversity_before, diversity_after,
    cluster_warning, n_effective, n_total). Rows that have all factors count,
    so one matrix of moments and one job of projections serve all candidates.
    Fewer than three others make no redundancy and a full diversity before.
    """
    beside_it = {f: [x for x in (factors if promoted is None else promoted) if x != f] for f in factors}
    sets = {f"-{f}": own for f, own in beside_it.items()} | {f"+{f}": [*own, f] for f, own in beside_it.items()}
    # Equal sets are looked at once.
    distinct = {tuple(sorted(own)): name for name, own in reversed(sets.items())}
    wide = wide.dropna(subset=list(dict.fromkeys(x for own in sets.values() for x in own)))
    reports = diversity_of_sets(wide, {name: list(own) for own, name in distinct.items()})
    named = wide.sparkSession.createDataFrame(
        [(f, distinct[tuple(sorted(sets[f"-{f}"]))], distinct[tuple(sorted(sets[f"+{f}"]))]) for f in factors],
        f"{FACTOR} string, before string, after string",
    )
    before = reports.select(c("name").alias("before"), c("diversity_score").alias("diversity_before"))
    after = reports.select(c("name").alias("after"), c("diversity_score").alias("diversity_after"), "cluster_warning", "n_effective", "n_total")
    return _redundancy(wide, beside_it).join(named.join(before, "before").join(after, "after").drop("before", "after"), FACTOR)


def _redundancy(wide: DataFrame, beside_it: dict[str, list[str]], threshold: float = 0.85) -> DataFrame:
    """(factor_id, r_squared, is_redundant) of each factor on its own list of at least three others, from one matrix."""
    names = list(dict.fromkeys(x for f, own in beside_it.items() for x in (f, *own)))
    n, _, cov = MO.moment_matrix(wide, names)
    cov = standardised(n, cov)[1] if n else cov
    rows = []
    for f, own in beside_it.items():
        at = [names.index(x) for x in (f, *own)]
        r2 = _regressed(cov[np.ix_(at, at)], 0)[0] if n >= 50 and len(own) >= 3 else 0.0
        rows.append((f, round(float(r2), 3), bool(r2 > threshold)))
    return wide.sparkSession.createDataFrame(rows, f"{FACTOR} string, r_squared double, is_redundant boolean")


def latest_snapshot(df: DataFrame, at_least: int = 25) -> DataFrame:
    """(factor, symbol, value) on each factor's last date; under 25 names with a value gives none.

    Of repeated rows the largest value counts.
    """
    last = df.groupBy(FACTOR).agg(F.max(DATE).alias(DATE))
    today = df.join(F.broadcast(last), [FACTOR, DATE]).where(c("value").isNotNull())
    today = today.groupBy(FACTOR, DATE, SYMBOL).agg(F.max("value").alias("value"))
    enough = today.groupBy(FACTOR).count().where(c("count") >= at_least).select(FACTOR)
    return today.join(F.broadcast(enough), FACTOR, "left_semi")


# --- penalties -------------------------------------------------------------

REDUNDANCY_SOFT, REDUNDANCY_HARD = 0.55, 0.85
WEIGHTS = {"redundancy": 0.45, "diversity": 0.20, "health": 0.35}
SHRINK_FLOOR = 0.60


def _unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def effective_shrinkage(n_effective: Column, n_total: Column, floor: float = SHRINK_FLOOR) -> Column:
    eff = F.least(F.greatest(F.coalesce(n_effective, n_total), F.lit(1.0)), n_total)
    shrink = F.round(F.least(F.greatest(F.sqrt(ratio(eff, n_total)), F.lit(floor)), F.lit(1.0)), 4)
    return F.when(n_total > 1.0, shrink).otherwise(1.0)


def with_penalties(df: DataFrame) -> DataFrame:
    """Penalty, multiplier, shrinkage and rank_score from a candidate's check results.

    Expects r_squared, is_redundant, diversity_before, diversity_after,
    cluster_warning, n_effective, n_total, n_ic, health_score, regime_change,
    composite_score.
    """
    redundancy = _unit((c("r_squared") - REDUNDANCY_SOFT) / (REDUNDANCY_HARD - REDUNDANCY_SOFT))
    redundancy = F.when(c("is_redundant"), F.greatest(redundancy, F.lit(0.8))).otherwise(redundancy)
    drop = F.greatest(c("diversity_before") - c("diversity_after"), F.lit(0.0))
    diversity = _unit(drop / 0.25)
    worse = c("cluster_warning") & (c("diversity_after") < c("diversity_before"))
    diversity = F.when(worse, F.least(F.lit(1.0), diversity + 0.15)).otherwise(diversity)
    health = _unit((0.60 - c("health_score")) / 0.60)
    health = F.when(c("regime_change"), F.least(F.lit(1.0), health + 0.20)).otherwise(health)
    health = F.when(c("n_ic") >= 20, health).otherwise(0.0)
    total = WEIGHTS["redundancy"] * redundancy + WEIGHTS["diversity"] * diversity + WEIGHTS["health"] * health
    return (
        df.withColumn("_total", total)
        .withColumns(
            {
                "penalty": F.round("_total", 3),
                "_mult": F.greatest(F.lit(0.15), 1.0 - c("_total")),
                "n_eff_shrinkage": effective_shrinkage(c("n_effective"), c("n_total").cast("double")),
            }
        )
        .withColumns(
            {
                "multiplier": F.round("_mult", 3),
                "rank_score": F.round(c("composite_score") * c("_mult") * c("n_eff_shrinkage"), 6),
            }
        )
        .drop("_total", "_mult")
    )
