import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigloom.functions.formula import look_back
from sigloom.operators import panel as P
from sigloom.plans.evaluate import compute_factors
from sigloom.plans.export import recent_panel


@pytest.mark.parametrize(
    "text, bars",
    [("close", 0), ("rank(-ret_5d)", 5), ("delta(ts_mean(close, 5), 10)", 14), ("ts_corr(ts_mean(close, 3), shift(volume, 4), 20)", 23),
     ("volume_ratio / ts_mean(volume, 5) + 1", 19), ("rank(decay_exp(close, 5))", None), ("max(ts_std(ret_1d, 20), 2)", 20),
     ("ts_mean(rank(delta(close, 2)), 5)", 6), ("clamp(close, 1, 2) * quantile(ts_sum(high, 7), 4)", 6), ("neutralize(ts_max(low, 9), sector)", 8)],
)
def test_look_back(text, bars):
    assert look_back(text) == bars


def stored(spark, days=300):
    rng = np.random.RandomState(2)
    rows = []
    for k in range(14):
        own = pd.bdate_range("2020-01-01", periods=days)
        own = own[rng.rand(days) < 0.6] if k % 3 == 1 else own[:100] if k == 5 else own
        for d in own:
            close = float(20 + 5 * rng.rand())
            rows.append((f"s{k:02d}", d.date(), close, close + 1, close - 1, close, float(100 + 50 * rng.rand()), 1.0))
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/bars"
    df = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double, amount double")
    df.repartitionByRange(6, "date").sortWithinPartitions("date").write.parquet(path)
    return spark.read.parquet(path)


FORMULAS = {"a": "rank(delta(ts_mean(close, 5), 10))", "b": "ts_mean(rank(volume), 4)", "c": "-ts_corr(close, volume, 20)"}


def test_recent_signals_are_those_of_all_history(spark):
    bars = stored(spark)
    _, signals = recent_panel(bars, FORMULAS, "2020-12-15", lookback=10, lag=2)
    full = P.with_features(P.index_bars(bars)).withColumn("fwd_5", P.forward_return(5))
    want = compute_factors(full, FORMULAS, keep=("fwd_5",)).toPandas().set_index(["symbol", "date"]).sort_index()
    got = signals.toPandas()
    assert got["date"].nunique() == 13 and str(got["date"].max()) == "2020-12-15"
    for f, own in got.groupby("factor_id"):
        own = own.set_index(["symbol", "date"]).sort_index()
        same = want.loc[own.index]
        np.testing.assert_allclose(own["value"].astype(float), same[f].astype(float))
        np.testing.assert_allclose(own["fwd_5"].astype(float), same["fwd_5"].astype(float))
    dates = set(got["date"])
    assert len(got) == 3 * sum(d in dates for _, d in want.index)


def test_the_scan_is_bounded(spark):
    bars = stored(spark)
    near = P.bars_around(bars, "2020-12-01", "2020-12-15", 14, 5)
    plan = near._jdf.queryExecution().executedPlan().toString()
    pushed = [x for x in plan.splitlines() if "FileScan" in x and "volume" in x]
    assert pushed and "GreaterThanOrEqual(date," in pushed[0] and "LessThanOrEqual(date," in pushed[0]
    counts = {r["symbol"]: r["n"] for r in near.where("date < DATE'2020-12-01'").groupBy("symbol").agg(F.count("close").alias("n")).collect()}
    assert set(counts.values()) == {14} and "s05" not in counts
    after = near.where("date > DATE'2020-12-15'").groupBy("symbol").count().agg(F.max("count"), F.min("count")).first()
    assert tuple(after) == (5, 5)
    assert P.bars_around(bars, "1990-01-01", "1990-02-01", 3).count() == 0
    assert P.bars_around(bars, "2020-12-01", "2020-12-15", None).where("symbol = 's00'").count() == bars.where("symbol = 's00' AND date <= DATE'2020-12-15'").count()


def test_a_universe_bounds_cross_sections_not_history(spark):
    bars = stored(spark, 60).withColumn("market_cap", F.col("volume"))
    flagged = P.membership(bars, 5)
    assert flagged.groupBy("date").agg(F.count_if("in_universe").alias("n")).where("n > 5").count() == 0
    panel = P.with_features(P.index_bars(flagged))
    got = compute_factors(panel, {"v": "rank(delta(close, 3)) - zscore(close)"}, member=P.MEMBER).toPandas().set_index(["symbol", "date"])["v"].sort_index()
    frame = panel.select("symbol", "date", "close", "in_universe").toPandas().sort_values(["symbol", "date"])
    frame["d"] = frame.groupby("symbol")["close"].diff(3).where(frame["in_universe"])
    frame["x"] = frame["close"].where(frame["in_universe"])
    day = frame.groupby("date")
    frame["v"] = day["d"].rank(pct=True) - (frame["x"] - day["x"].transform("mean")) / day["x"].transform("std")
    np.testing.assert_allclose(got.astype(float), frame.set_index(["symbol", "date"])["v"].sort_index())


def test_recent_signals_are_written_once(spark):
    """Each step of a report reads the signals: none of them may repeat the windows."""
    bars = stored(spark)
    _, signals = recent_panel(bars, FORMULAS, "2020-12-15", lookback=10, lag=2)
    plan = signals._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "FileScan" not in plan
    plain = {"a": "rank(delta(ts_mean(close, 5), 10))", "b": "rank(volume)"}
    one, other = (
        recent_panel(bars, plain, "2020-12-15", lookback=10, lag=2, width=w)[1].toPandas().set_index(["factor_id", "symbol", "date"]).sort_index()
        for w in (None, 14)
    )
    np.testing.assert_allclose(one.astype(float), other.loc[one.index].astype(float))
    assert len(one) == len(other)
