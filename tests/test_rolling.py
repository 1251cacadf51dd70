import math

import numpy as np
import pandas as pd
import pytest
from helpers import bars
from pyspark.sql import functions as F

from sigloom.functions import rolling as R
from sigloom.operators import indicators as I, panel as P

N = 5


def series(seed=0, n=60):
    rng = np.random.RandomState(seed)
    x = np.round(rng.rand(n) * 10 + 1, 1)
    out = [float(v) for v in x]
    for k in (7, 8, 30):
        out[k] = None
    out[40:50] = [3.0] * 10  # constant windows, ties
    return out


DATA = {"a": series(1), "b": series(2), "short": [1.0, 2.0, 3.0]}


def pct_rank(a):
    return (a[:-1] < a[-1]).sum() / (len(a) - 1)


w = np.arange(1, N + 1) / (N * (N + 1) / 2)
CASES = {
    "ts_mean": lambda s: s.rolling(N).mean(),
    "ts_sum": lambda s: s.rolling(N).sum(),
    "ts_std": lambda s: s.rolling(N).std(),
    "ts_max": lambda s: s.rolling(N).max(),
    "ts_min": lambda s: s.rolling(N).min(),
    "ts_rank": lambda s: s.rolling(N).apply(pct_rank, raw=True),
    "ts_argmax": lambda s: s.rolling(N).apply(lambda a: len(a) - 1 - np.argmax(a), raw=True),
    "ts_argmin": lambda s: s.rolling(N).apply(lambda a: len(a) - 1 - np.argmin(a), raw=True),
    "ts_count": lambda s: (s > 0).astype(float).rolling(N, min_periods=1).sum(),
    "ts_product": lambda s: s.rolling(N).apply(np.prod, raw=True),
    "delta": lambda s: s - s.shift(N),
    "pct_change": lambda s: s / s.shift(N) - 1,
    "shift": lambda s: s.shift(N),
    "decay_linear": lambda s: s.rolling(N).apply(lambda a: a @ w, raw=True),
    "decay_exp": lambda s: s.ewm(halflife=N, min_periods=N).mean(),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_against_pandas(spark, name):
    df = P.index_bars(bars(spark, DATA))
    got = df.select("symbol", "bar_no", getattr(R, name)(F.col("close"), N).alias("x")).toPandas()
    for sym, cl in DATA.items():
        want = CASES[name](pd.Series(cl, dtype=float)).to_numpy()
        mine = got[got.symbol == sym].sort_values("bar_no")["x"].to_numpy(dtype=float)
        np.testing.assert_allclose(mine, want, rtol=1e-9, atol=1e-9)


def test_moments_on_full_and_constant_windows(spark):
    df = P.index_bars(bars(spark, DATA)).where("symbol = 'a'")
    got = df.select("bar_no", R.ts_skew(F.col("close"), N).alias("s"), R.ts_kurt(F.col("close"), N).alias("k")).toPandas()
    x = pd.Series(DATA["a"], dtype=float)
    got = got.sort_values("bar_no")
    varied = x.rolling(N).std() > 0
    np.testing.assert_allclose(got["s"][varied.values], x.rolling(N).skew()[varied], rtol=1e-7)
    np.testing.assert_allclose(got["k"][varied.values], x.rolling(N).kurt()[varied], rtol=1e-7)
    assert got["s"].iloc[48] == 0.0 and got["k"].iloc[48] == -3.0


def test_pairs_need_both_sides(spark):
    df = P.index_bars(bars(spark, DATA)).where("symbol = 'a'")
    got = df.select(
        "bar_no", "close", "volume", R.ts_corr(F.col("close"), F.col("volume"), N).alias("r"),
        R.ts_cov(F.col("close"), F.col("volume"), N).alias("c"),
    ).toPandas().sort_values("bar_no")
    want = got["close"].rolling(N).cov(got["volume"])
    np.testing.assert_allclose(got["c"], want, rtol=1e-9, atol=1e-9)
    assert math.isnan(got["r"].iloc[47])  # constant close


def test_decay_survives_long_series_and_gaps(spark):
    n = 3000
    x = [float(math.sin(i) + 2) for i in range(n)]
    for i in range(1000, 2600):
        x[i] = None
    df = P.index_bars(bars(spark, {"a": x}))
    got = df.select("bar_no", R.decay_exp(F.col("close"), 2).alias("x")).toPandas().sort_values("bar_no")["x"]
    want = pd.Series(x, dtype=float).ewm(halflife=2, min_periods=2).mean()
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_rsi_matches_the_recursion(spark):
    rng = np.random.RandomState(5)
    x = list(np.cumsum(rng.randn(6000)) + 500)
    df = P.index_bars(bars(spark, {"a": x, "flat": [5.0] * 40}))
    got = df.select("symbol", "bar_no", I.rsi().alias("x")).toPandas()
    d = np.diff(x)
    g, l = np.maximum(d, 0), np.maximum(-d, 0)
    ag, al, want = g[:14].mean(), l[:14].mean(), {}
    for i in range(14, len(d)):
        ag, al = (ag * 13 + g[i]) / 14, (al * 13 + l[i]) / 14
        want[i + 2] = 100 - 100 / (1 + ag / al)
    a = got[got.symbol == "a"].set_index("bar_no")["x"]
    assert a[a.index <= 15].isna().all()
    np.testing.assert_allclose(a[list(want)], list(want.values()), rtol=1e-8)
    assert got[got.symbol == "flat"]["x"].isna().all()


def test_true_range_needs_five_bars(spark):
    df = I.with_atr(P.index_bars(bars(spark, {"a": [10.0, 11, 12, 13, 14, 15]})))
    got = df.orderBy("bar_no").select("atr_14").toPandas()["atr_14"]
    assert got[:4].isna().all() and got[4:].notna().all()
