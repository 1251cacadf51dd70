import datetime as dt

import numpy as np
import pandas as pd
import pytest
from helpers import bars
from pyspark.sql import functions as F

from sigloom.functions import cross as C, scalar as S
from sigloom.functions.formula import formula, split
from sigloom.operators import panel as P
from sigloom.operators import ranking as K
from sigloom.plans.evaluate import compute_factor, compute_factors, evaluate_formula

D = dt.date(2024, 1, 2)


def test_scalars_turn_invalid_into_missing(spark):
    df = spark.createDataFrame([(-2.0, 0.0), (4.0, 2.0), (None, 1.0)], "x double, y double")
    x, y = F.col("x"), F.col("y")
    rows = df.select(
        S.log(x).alias("log"), S.sqrt(x).alias("sqrt"), S.power(x, 0.5).alias("pow"), S.ratio(x, y).alias("div"),
        S.clamp(x, -1, 1).alias("clamp"), S.larger(x, y).alias("max"), S.smaller(x, 1).alias("min"),
        S.if_then(x, 1, 0).alias("if"), S.sign(x).alias("sign"),
    ).collect()
    assert [r["log"] is None for r in rows] == [True, False, True]
    assert rows[0]["sqrt"] is None and rows[1]["sqrt"] == 2.0 and rows[0]["pow"] is None
    assert rows[0]["div"] is None and rows[1]["div"] == 2.0
    assert [r["clamp"] for r in rows] == [-1.0, 1.0, None]
    assert [r["max"] for r in rows] == [0.0, 4.0, 1.0] and [r["min"] for r in rows] == [-2.0, 1.0, 1.0]
    assert [r["if"] for r in rows] == [0.0, 1.0, 0.0] and rows[0]["sign"] == -1.0


def test_pearson_of_a_constant_is_missing(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "a double, b double")
    assert df.agg(S.pearson(F.col("a"), F.col("b")).alias("r")).first()["r"] is None


def test_cross_sections_skip_missing(spark):
    vals = [3.0, 1.0, None, 3.0, 2.0]
    df = spark.createDataFrame([(f"s{i}", D, v, "g" if i < 2 else None) for i, v in enumerate(vals)], "symbol string, date date, x double, g string")
    want = pd.Series(vals, dtype=float).rank(pct=True)
    got = C.with_ranks(df, {"r": "x"}).orderBy("symbol").toPandas()["r"]
    np.testing.assert_allclose(got, want)
    z = C.with_zscores(df, {"z": "x"}).orderBy("symbol").toPandas()["z"]
    s = pd.Series(vals, dtype=float)
    np.testing.assert_allclose(z, (s - s.mean()) / s.std())
    same = df.where("x = 3.0")
    assert [r["z"] for r in C.with_zscores(same, {"z": "x"}).collect()] == [0.0, 0.0]
    n = C.with_neutralized(df, "x", "g", "n").orderBy("symbol").toPandas()["n"]
    np.testing.assert_allclose(n, [1.0, -1.0, np.nan, 0.5, -0.5])


def test_formula_text_and_builders_agree(spark):
    df = P.with_features(P.index_bars(bars(spark, {s: [float(10 + (i * k) % 7) for i in range(30)] for k, s in enumerate("abcd", 2)})))
    a = compute_factor(df, "rank(-delta(close, 3)) * 2 / (high - low)").toPandas().sort_values(["symbol", "date"])
    from sigloom.functions import rolling as R

    b = df.select("symbol", "date", (-R.delta(F.col("close"), 3)).alias("v"), (F.col("high") - F.col("low")).alias("w"))
    b = b.toPandas().sort_values(["symbol", "date"])
    with np.errstate(divide="ignore", invalid="ignore"):
        want = b.groupby("date")["v"].rank(pct=True) * 2 / b["w"].replace(0.0, np.nan)
    np.testing.assert_allclose(a["factor_value"], want)


def test_formulas_are_cut_at_per_date_nodes():
    stages, rest = split({"a": "rank(ts_mean(rank(close), 5)) * rank(close)", "b": "zscore(rank(close)) + delta(rank(close), 2)"})
    assert [[(n.operator, n.inputs) for n in s] for s in stages] == [
        [("rank", ("close",))], [("rank", ("ts_mean(_d0, 5)",)), ("zscore", ("_d0",))],
    ]
    assert rest == {"a": "_d1 * _d0", "b": "_d2 + delta(_d0, 2)"}
    assert split({"x": "close / open"}) == ([], {"x": "close / open"})
    assert split({"x": "quantile(close, 4)"})[0][0][0].number == 4


def test_nested_per_date_nodes_against_pandas(spark):
    rng = np.random.RandomState(7)
    closes = {f"s{k:02d}": [float(x) for x in rng.randint(5, 25, 24)] for k in range(15)}
    df = P.with_features(P.index_bars(bars(spark, closes)))
    got = compute_factor(df, "rank(ts_mean(zscore(close), 3)) - demean(quantile(close, 4)) * rank(close)")
    got = got.toPandas().sort_values(["symbol", "date"])["factor_value"].to_numpy(dtype=float)
    b = df.select("symbol", "date", "close").toPandas().sort_values(["symbol", "date"])
    day = b.groupby("date")["close"]
    b["z"] = (b["close"] - day.transform("mean")) / day.transform("std")
    b["m"] = b.groupby("symbol")["z"].transform(lambda x: x.rolling(3).mean())
    b["q"] = day.transform(lambda x: np.searchsorted(np.quantile(x, [0.25, 0.5, 0.75]), x, side="left") + 1.0)
    want = b.groupby("date")["m"].rank(pct=True) - (b["q"] - b.groupby("date")["q"].transform("mean")) * day.rank(pct=True)
    np.testing.assert_allclose(got, want)


def test_a_hot_date_is_spread_through_a_formula(spark):
    """A third of all rows on one date: no task gets the date, and ranks are exact."""
    hot = spark.range(30_000).selectExpr("concat('s', id) AS symbol", "DATE'2024-01-02' AS date", "1L AS bar_no", "pow(id % 9973 + 1, 2) / 7D AS close")
    cold = spark.range(60_000).selectExpr("concat('s', id % 600) AS symbol", "date_add(DATE'2024-02-01', int(id div 600)) AS date", "id div 600 AS bar_no", "1D + id % 13 AS close")
    got = compute_factor(hot.unionByName(cold), "rank(close)")
    want = hot.toPandas().set_index("symbol")["close"].rank(pct=True).sort_index()
    mine = got.where("date = DATE'2024-01-02'").toPandas().set_index("symbol")["factor_value"].sort_index()
    np.testing.assert_allclose(mine, want)
    ranges = hot.select(K.value_range(F.col("close")).alias("r")).groupBy("r").count().agg(F.max("count"), F.count("r")).first()
    assert ranges[0] < 30_000 / 4 and ranges[1] > 30
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    over_date = [x for x in plan.splitlines() if "Window [" in x and "_range" not in x and "_held" not in x]
    assert over_date == []


@pytest.mark.parametrize("bad", ["close.real", "__import__('os')", "foo(close)", "[close]", "close if close else 1", "rank(close)"])
def test_formula_rejects_what_is_not_a_formula(spark, bad):
    with pytest.raises(ValueError):
        formula(bad)


def test_universe_breaks_ties_and_puts_unknown_caps_last(spark):
    df = spark.createDataFrame([("b", D, 5.0), ("a", D, 5.0), ("c", D, None), ("d", D, 1.0)], "symbol string, date date, market_cap double")
    assert sorted(r["symbol"] for r in P.universe(df, 1).collect()) == ["a"]
    assert sorted(r["symbol"] for r in P.universe(df, 3).collect()) == ["a", "b", "d"]


def test_evaluate_formula_runs_end_to_end(spark):
    rng = np.random.RandomState(0)
    closes = {f"s{k:02d}": list(50 + 10 * rng.rand(260)) for k in range(30)}
    out = evaluate_formula(bars(spark, closes), "rank(-ret_5d)", "2020-08-20", width=30)
    assert out["folds"].count() == 2
    # independent prices revert, so the reversal factor predicts
    assert out["summary"].first()["avg_ic"] > 0.2


def test_quantile_and_neutralize_in_formulas(spark):
    rng = np.random.RandomState(2)
    rows = [(D, f"s{k:02d}", float(v), "ab"[k % 2]) for k, v in enumerate(rng.randint(0, 12, 40))] + [(D, "none", None, "a")]
    df = spark.createDataFrame(rows, "date date, symbol string, x double, sector string")
    got = compute_factors(df.withColumn("bar_no", F.lit(1)), {"q": "quantile(x, 4)", "m": "neutralize(x, sector)"}).select("symbol", "q", "m").toPandas().set_index("symbol")
    split = C.with_neutralized(C.with_quantiles(df, "x", "q", 4), "x", "sector", "m").select("symbol", "q", "m").toPandas().set_index("symbol")
    pd.testing.assert_frame_equal(got.sort_index(), split.sort_index(), check_dtype=False)
