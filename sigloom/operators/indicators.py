"""Classic per-symbol indicators, as window expressions over the numbered panel."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..columns import BAR, DATE, SYMBOL
from ..functions import rolling as R
from ..functions.scalar import log, pearson, ratio

c = F.col


def _span(a: int, b: int):
    return R.by_symbol().rowsBetween(a, b)


def _after(bars: int, x: Column) -> Column:
    """``x`` from the bar following the first ``bars`` bars."""
    return F.when(c(BAR) > bars, x)


def rsi(period: int = 14) -> Column:
    """Wilder's RSI: the recursion avg = (avg*(p-1) + move)/p in closed form.

    Seeded with the mean of the first ``period`` moves, the average at move i is
    r^(i-p)*seed plus the faded sum of the later moves, r = (p-1)/p.
    """
    move = c("close") - R.shift(c("close"), 1)
    rate = math.log((period - 1) / period)
    age = (c(BAR) - (period + 1)).cast("double")

    def wilder(x: Column) -> Column:
        first = F.when(c(BAR).between(2, period + 1), x)
        seed = F.avg(first).over(R.so_far())
        later = F.when(c(BAR) > period + 1, x / float(period))
        return seed * F.exp(age * rate) + R.faded_sum(later, rate)

    gain = wilder(F.greatest(move, F.lit(0.0)))
    loss = wilder(F.greatest(-move, F.lit(0.0)))
    return _after(period + 1, F.when(loss >= 1e-10, 100.0 - 100.0 / (1.0 + ratio(gain, loss))))


def bollinger_position(period: int = 20, width: float = 2.0) -> Column:
    w = R.trailing(period)
    mean, sd = F.avg("close").over(w), F.stddev_pop("close").over(w)
    place = ratio(c("close") - (mean - sd * width), sd * (2 * width))
    inside = F.least(F.greatest(place, F.lit(0.0)), F.lit(1.0))
    return _after(period, F.when(sd < 1e-10, 0.5).otherwise(inside))


def ma_distance(period: int = 20) -> Column:
    mean = F.avg("close").over(R.trailing(period))
    return _after(period, F.when(mean > 1e-10, ratio(c("close") - mean, mean)))


def volume_ratio(period: int = 20) -> Column:
    """Volume over the mean of the ``period`` bars before today."""
    mean = F.avg("volume").over(_span(-period, -1))
    return _after(period, F.when(mean > 0, ratio(c("volume"), mean)))


def with_log_returns(df: DataFrame) -> DataFrame:
    """``lr`` and its predecessor ``lr_prev``, shared by regime and squeeze."""
    lr = F.ln(F.greatest(c("close"), F.lit(1e-9)))
    return df.withColumn("lr", lr - F.lag(lr, 1).over(R.by_symbol())).withColumn(
        "lr_prev", F.lag("lr", 1).over(R.by_symbol())
    )


def regime(window: int = 20) -> Column:
    """0 trending, 1 mean-reverting, 2 noisy, from the lag-1 autocorrelation up to the previous bar."""
    ac = pearson(c("lr_prev"), c("lr"), over=_span(-(window - 1), -1))
    label = F.when(ac > 0.15, 0.0).when(ac < -0.10, 1.0).otherwise(2.0)
    return F.when(c(BAR) >= window + 2, label).otherwise(2.0)


def squeeze(short: int = 20, long: int = 60) -> Column:
    """Short over long deviation of log returns, both ending at the previous bar."""
    narrow = F.stddev_pop("lr").over(_span(-short, -1))
    broad = F.stddev_pop("lr").over(_span(-long, -1))
    return F.when((c(BAR) >= long + 2) & (broad > 1e-10), ratio(narrow, broad))


def reversion_score() -> Column:
    """Signed score in [-1, 1], positive when oversold; missing parts count as zero."""
    zero = F.lit(0.0)
    score = (
        0.35 * F.coalesce((50.0 - c("rsi_14")) / 50.0, zero)
        + 0.35 * F.coalesce((0.5 - c("bb_position")) * 2.0, zero)
        + 0.30 * F.coalesce(-c("ma20_dist") / 0.10, zero)
    )
    return F.least(F.greatest(score, F.lit(-1.0)), F.lit(1.0))


def _long_enough(df: DataFrame, bars: int) -> DataFrame:
    return df.withColumn("_bars", F.count(F.lit(1)).over(Window.partitionBy(SYMBOL))).where(c("_bars") >= bars)


FEATURES = [
    "rsi_14", "bb_position", "ma20_dist", "reversion_score", "regime", "volume_ratio", "squeeze_ratio", "ret_5d",
]


def feature_table(df: DataFrame, bars: int = 60, keep: tuple[str, ...] = ()) -> DataFrame:
    """All indicators, for symbols with at least ``bars`` bars and from bar ``bars`` (0-based) on."""
    staged = (
        _long_enough(with_log_returns(df), bars)
        .withColumns(
            {
                "rsi_14": rsi(),
                "bb_position": bollinger_position(),
                "ma20_dist": ma_distance(20),
                "regime": regime(),
                "volume_ratio": volume_ratio(),
                "squeeze_ratio": squeeze(),
                "ret_5d": R.pct_change(c("close"), 5),
                **{k: c(k) for k in keep},
            }
        )
        .where(c(BAR) > bars)
    )
    return staged.withColumn("reversion_score", reversion_score()).select(SYMBOL, DATE, *FEATURES, *keep)


def basic_features(df: DataFrame, bars: int = 60, first: int = 20, extras: tuple[str, ...] = ()) -> DataFrame:
    """Returns and volume ratio with pass-through columns, from bar ``first`` (0-based) on."""
    staged = _long_enough(df, bars).withColumns(
        {f"ret_{n}d": R.pct_change(c("close"), n) for n in (1, 5, 20)} | {"volume_ratio": volume_ratio()}
    )
    return staged.where(c(BAR) > first).select(
        SYMBOL, DATE, "close", "volume", "ret_1d", "ret_5d", "ret_20d", "volume_ratio", *extras
    )


def true_range() -> Column:
    prev = R.shift(c("close"), 1)
    return F.greatest(c("high") - c("low"), F.abs(c("high") - prev), F.abs(c("low") - prev))


def with_atr(df: DataFrame, n: int = 14, at_least: int = 5) -> DataFrame:
    w = R.trailing(n)
    df = df.withColumn("true_range", true_range())
    return df.withColumn(f"atr_{n}", F.when(F.count("true_range").over(w) >= at_least, F.avg("true_range").over(w)))
