import datetime as dt
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigloom.operators import composite as CO, health as H, moments as MO


def frame(spark, n, k, groups=1, seed=0):
    rng = np.random.RandomState(seed)
    x = rng.randn(n, k) @ rng.randn(k, k) + 1e6 * rng.randn(k)
    names = [f"x{i}" for i in range(k)]
    data = pd.DataFrame(x, columns=names)
    data["g"] = rng.randint(0, groups, n)
    return spark.createDataFrame(data).repartition(7), data, names


@pytest.mark.parametrize("held", [4_000_000, 20])
def test_grouped_moments_match_numpy(spark, monkeypatch, held):
    monkeypatch.setattr(MO, "HELD", held)
    df, data, names = frame(spark, 500, 4, groups=3)
    got = {r["g"]: r for r in MO.grouped_moments(df.unionByName(df.limit(5).withColumn("x0", F.lit(None).cast("double"))), F.array(*names), 4, "g").collect()}
    assert set(got) == {0, 1, 2}
    for g, own in data.groupby("g"):
        assert got[g]["n"] == len(own)
        np.testing.assert_allclose(got[g]["mean"], own[names].mean())
        np.testing.assert_allclose(np.reshape(got[g]["cov"], (4, 4)), np.cov(own[names].T, ddof=0), rtol=1e-6)


def test_moment_matrix_of_many_columns_is_one_small_plan(spark):
    df, data, names = frame(spark, 300, 60)
    n, mean, cov = MO.moment_matrix(df, names)
    assert n == 300
    np.testing.assert_allclose(cov, np.cov(data[names].T, ddof=0), rtol=1e-5, atol=1e-6)
    assert MO.moment_matrix(df.where("false"), names)[0] == 0


def test_every_r_squared_from_one_inverse(spark):
    rng = np.random.RandomState(4)
    x = rng.randn(200, 5)
    x[:, 4] = x[:, 0] - 0.5 * x[:, 1] + 0.3 * rng.randn(200)
    names = list("abcde")
    df = spark.createDataFrame(pd.DataFrame(x, columns=names))
    got = {r["factor_id"]: r for r in H.collinearity_of_all(df, names).collect()}
    for i, f in enumerate(names):
        rest = np.delete(x, i, axis=1)
        design = np.column_stack([np.ones(200), rest])
        fit = design @ np.linalg.lstsq(design, x[:, i], rcond=None)[0]
        r2 = 1 - ((x[:, i] - fit) ** 2).sum() / ((x[:, i] - x[:, i].mean()) ** 2).sum()
        assert got[f]["r_squared"] == pytest.approx(r2, abs=6e-4) and got[f]["is_redundant"] == (r2 > 0.85)
        one = H.collinearity(df, f, [n for n in names if n != f]).first()
        assert one["top"] == got[f]["top"]
    twin = df.withColumn("f", F.col("a"))
    assert {r["factor_id"]: r["r_squared"] for r in H.collinearity_of_all(twin, [*names, "f"]).collect()}["a"] == 1.0


def test_candidate_checks_see_a_twin(spark):
    rng = np.random.RandomState(6)
    x = rng.randn(120, 4)
    df = spark.createDataFrame(pd.DataFrame(np.column_stack([x, x[:, 0] + 0.01 * rng.randn(120)]), columns=list("abcde")))
    got = {r["factor_id"]: r for r in H.candidate_checks(df, list("abcde")).collect()}
    assert {f for f, r in got.items() if r["is_redundant"]} == {"a", "e"}
    assert {r["n_total"] for r in got.values()} == {5} and got["a"]["n_effective"] < 4.5
    alone = H.factor_diversity(df, list("bcde")).first()["diversity_score"]
    assert got["a"]["diversity_before"] == alone


def test_order_statistics_by_counting(spark):
    rng = np.random.RandomState(8)
    many = spark.range(1_000_000).select(((F.col("id") * 7919) % 1_000_003).cast("double").alias("v"))
    values = np.sort((np.arange(1_000_000) * 7919) % 1_000_003)
    assert MO.median(many, F.col("v")) == (values[499_999] + values[500_000]) / 2
    ties = np.concatenate([np.full(700, 3.5), rng.standard_cauchy(301), [1e300, -1e300]])
    df = spark.createDataFrame(pd.DataFrame({"v": ties}))
    assert MO.median(df, F.col("v")) == np.median(ties)
    assert MO.order_statistics(df, F.col("v"), [0, 5, 1002]) == list(np.sort(ties)[[0, 5, 1002]])
    assert MO.median(df.where("false"), F.col("v")) is None
    assert MO.median(df.limit(1), F.col("v")) == ties[0]


def test_outliers_of_sixty_factors_plan_quickly(spark):
    factors = [f"f{i}" for i in range(60)]
    rng = np.random.RandomState(2)
    rows = [(f, f"s{i}", dt.date(2024, 1, 1), float(rng.randn()), 1) for f in factors for i in range(80)]
    labels = spark.createDataFrame(rows, "factor_id string, symbol string, date date, value double, q int")
    daily = labels.select("factor_id", "date").distinct()
    began = time.time()
    out = CO.distance_outliers(labels, daily, factors, 70, width=80)
    out._jdf.queryExecution().executedPlan()
    assert time.time() - began < 5
    assert out.count() == 16


def test_outlier_distances_are_those_of_the_plain_inverse(spark):
    """Damping every eigenvalue changed distances in the seventh digit, and with it the order of near ones."""
    rng = np.random.RandomState(7)
    x = rng.randn(400, 3)
    x[:, 1] = x[:, 0] + 0.05 * rng.randn(400)
    rows = spark.createDataFrame([(str(i), dt.date(2020, 1, 1), [*map(float, v), 0.0]) for i, v in enumerate(x)], "symbol string, date date, x array<double>")
    got = {r["symbol"]: r["distance"] for r in CO.measured_distances(rows, 4, 50).collect()}
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    want = np.sqrt(np.einsum("ni,ij,nj->n", z, np.linalg.inv(np.corrcoef(z.T)), z))
    np.testing.assert_allclose([got[str(i)] for i in range(400)], want, atol=2e-9)
