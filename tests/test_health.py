import math

import numpy as np
from helpers import dates

from sigloom.operators import bootstrap as BS, composite as CO, diagnostics as D, health as H


def series(spark, data: dict):
    rows = [(f, d, float(x)) for f, xs in data.items() for d, x in zip(dates(len(xs)), xs)]
    return spark.createDataFrame(rows, "factor_id string, date date, ic double")


def ep(x):
    x = np.asarray(x)
    z = (x - x.mean()) / x.std()
    t = np.linspace(0.1, 3.0, 20)
    cf = np.exp(1j * np.outer(t, z)).mean(axis=1)
    return float((len(x) * np.abs(cf - np.exp(-t**2 / 2)) ** 2 * np.exp(-t**2 / 2)).mean())


def test_epps_pulley_matches_numpy(spark):
    rng = np.random.RandomState(0)
    data = {"normal": rng.randn(200), "skewed": rng.exponential(size=200), "few": rng.randn(9), "flat": np.ones(50)}
    got = {r["factor_id"]: r["ep"] for r in H.epps_pulley(series(spark, data), ["factor_id"], "ic").collect()}
    assert abs(got["normal"] - ep(data["normal"])) < 1e-9 and abs(got["skewed"] - ep(data["skewed"])) < 1e-9
    assert got["few"] == 0.0 and got["flat"] == 999.0


def test_ic_health_flags_drift(spark):
    rng = np.random.RandomState(1)
    good = 0.05 + 0.02 * rng.randn(200)
    turned = np.concatenate([good[:140], -0.1 + 0.02 * rng.randn(60)])
    got = {r["factor_id"]: r for r in H.ic_health(series(spark, {"good": good, "turned": turned}), 60).collect()}
    assert got["good"]["health_score"] == 1.0 and not got["good"]["regime_change"]
    assert got["turned"]["regime_change"] and got["turned"]["health_score"] <= 0.3
    few = H.ic_health(series(spark, {"few": good[:10]})).first()
    assert few["health_score"] == 0.5 and few["regime_change"] is False


def snapshot(spark, x, names):
    rows = [(f"s{i}", *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "symbol string, " + ", ".join(f"{n} double" for n in names))


def test_diversity_and_effective_count_match_numpy(spark):
    rng = np.random.RandomState(2)
    x = rng.randn(120, 4)
    x[:, 3] = x[:, 0] + 0.1 * rng.randn(120)
    got = H.factor_diversity(snapshot(spark, x, list("abcd")), list("abcd")).first()
    z = (x - x.mean(0)) / (x.std(0) + 1e-12)
    d = np.random.RandomState(42).randn(200, 4)
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    stats = np.array([ep(z @ v) for v in d])
    assert got["mean_ep"] == round(stats.mean(), 3)
    lam = np.linalg.eigvalsh(np.corrcoef(z.T))
    p = lam[lam > 0.01] / lam[lam > 0.01].sum()
    assert got["n_effective"] == round(float(np.exp(-(p * np.log(p + 1e-12)).sum())), 1)
    two = H.factor_diversity(snapshot(spark, x[:, :2], list("ab")), list("ab")).first()
    assert two["diversity_score"] == 1.0 and two["n_total"] == 2


def test_collinearity_matches_least_squares(spark):
    rng = np.random.RandomState(3)
    x = rng.randn(100, 4)
    y = x[:, 0] * 0.5 - x[:, 2] + rng.randn(100)
    got = H.collinearity(snapshot(spark, np.column_stack([y, x]), list("yabcd")), "y", list("abcd")).first()
    zs = (x - x.mean(0)) / x.std(0)
    zy = (y - y.mean()) / y.std()
    beta = np.linalg.lstsq(zs, zy, rcond=None)[0]
    assert got["r_squared"] == round(1 - ((zy - zs @ beta) ** 2).sum() / (zy**2).sum(), 3)
    assert got["top"][0]["factor"] == "c" and abs(got["top"][0]["beta"] - abs(beta[2])) < 1e-3
    few = H.collinearity(snapshot(spark, np.column_stack([y, x])[:30], list("yabcd")), "y", list("abcd")).first()
    assert few["r_squared"] == 0.0


def test_bootstrap_separates_signal_from_noise_and_repeats(spark):
    rng = np.random.RandomState(4)
    data = {"strong": 0.1 + 0.05 * rng.randn(120), "noise": 0.05 * rng.randn(120), "few": rng.randn(5)}
    data["noise"] -= data["noise"].mean() - 0.001
    run = lambda: {r["factor_id"]: r for r in BS.bootstrap_significance(series(spark, data), 1000).collect()}
    a, b = run(), run()
    assert a == b
    assert a["strong"]["significant_01"] and not a["noise"]["significant_05"]
    assert a["few"]["p_value"] == 1.0 and a["few"]["n_bootstrap"] == 0 and a["few"]["percentile"] == 50.0
    assert a["strong"]["n_bootstrap"] == 1000 and a["strong"]["block_size"] == 11
    assert abs(a["strong"]["null_mean"]) < 0.005


def test_phase_dimension_matches_numpy(spark):
    rng = np.random.RandomState(5)
    x = rng.randn(400)
    got = D.phase_dimension(series(spark, {"f": x, "few": x[:100]})).toPandas().set_index("factor_id")
    pts = np.column_stack([x[0:390], x[5:395], x[10:400]])
    i, j = np.triu_indices(390, 1)
    gaps = np.linalg.norm(pts[i] - pts[j], axis=1)
    e = np.percentile(gaps, [5, 10, 20, 30, 50])
    near = [(gaps < v).mean() for v in e]
    dim = np.mean([np.log(near[k + 1] / near[k]) / np.log(e[k + 1] / e[k]) for k in range(4)])
    assert abs(got.loc["f", "dimension"] - dim) < 0.01
    np.testing.assert_allclose(D.distance_quantiles(pts, [0.05, 0.1, 0.2, 0.3, 0.5]), e, rtol=1e-4)
    assert got.loc["few", "verdict"] == "insufficient_data" and got.loc["few", "dimension"] == 3.0


def test_wavelet_sees_fading_energy(spark):
    rng = np.random.RandomState(6)
    x = 0.1 * rng.randn(300)
    faded = np.concatenate([x[:240], 0.1 * x[240:]])
    got = D.wavelet_health(series(spark, {"steady": np.tile(x[:60], 5), "faded": faded, "few": x[:50]})).toPandas().set_index("factor_id")
    assert got.loc["faded", "overall"] == "degrading" and got.loc["few", "overall"] == "insufficient_data"
    assert got.loc["steady", "overall"] in ("healthy", "caution")


def test_autocorrelation_and_period_of_a_wave(spark):
    x = np.sin(2 * np.pi * np.arange(200) / 10)
    s = series(spark, {"wave": x, "few": x[:20]})
    per = D.dominant_periods(s).toPandas().set_index("factor_id")
    assert per.loc["wave", "period_1"] == 10.0 and per.loc["wave", "suggested_hold"] == 5 and per.loc["few", "suggested_hold"] == 5
    ac = D.autocorrelation(s).toPandas().set_index("factor_id")
    c = x - x.mean()
    assert abs(ac.loc["wave", "ac_5"] - round(float((c[5:] * c[:-5]).sum() / (c @ c)), 4)) < 1e-9
    assert ac.loc["few", "halflife"] == 1


def test_distance_outliers_match_svd(spark):
    rng = np.random.RandomState(7)
    x = rng.randn(150, 3)
    x[:, 2] += x[:, 0]
    d = dates(1)[0]
    rows = [(f, f"s{i:03d}", d, float(x[i, k]), 1) for k, f in enumerate("abc") for i in range(150)]
    labels = spark.createDataFrame(rows, "factor_id string, symbol string, date date, value double, q int")
    daily = labels.select("factor_id", "date").distinct()
    got = {r["symbol"] for r in CO.distance_outliers(labels, daily, list("abc"), 100, width=150).collect()}
    z = (x - x.mean(0)) / (x.std(0) + 1e-12)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    m = np.sqrt((((u * s) / (np.sqrt(s**2 / 150) + 1e-6)) ** 2).sum(1))
    assert got == {f"s{i:03d}" for i in np.where(m > np.percentile(m, 80))[0]}


def test_penalties_stay_within_bounds(spark):
    cols = (
        "factor_id string, r_squared double, is_redundant boolean, diversity_before double, diversity_after double, "
        "cluster_warning boolean, n_effective double, n_total int, n_ic int, health_score double, regime_change boolean, composite_score double"
    )
    rows = [
        ("clean", 0.1, False, 0.9, 0.9, False, 4.0, 4, 100, 1.0, False, 1.0),
        ("bad", 0.99, True, 0.9, 0.1, True, 1.0, 4, 100, 0.0, True, 1.0),
    ]
    got = H.with_penalties(spark.createDataFrame(rows, cols)).toPandas().set_index("factor_id")
    assert got.loc["clean", "rank_score"] == 1.0 and got.loc["clean", "penalty"] == 0.0
    assert got.loc["bad", "multiplier"] == 0.15 and got.loc["bad", "n_eff_shrinkage"] == 0.6
    assert math.isclose(got.loc["bad", "rank_score"], 0.09)
