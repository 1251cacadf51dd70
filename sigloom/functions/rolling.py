"""Per-symbol builders over row windows.

All of them expect a panel from ``operators.panel.index_bars``: hash-partitioned
by symbol, with ``bar_no`` numbering each symbol's bars from 1.  Every window
here is partitioned by symbol first, so any number of them shares that one
shuffle.  ``n`` counts bars, never calendar days.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, functions as F

from ..columns import BAR, SYMBOL
from .scalar import pearson, ratio


def by_symbol():
    return Window.partitionBy(SYMBOL).orderBy(BAR)


def trailing(n: int):
    return by_symbol().rowsBetween(-(n - 1), Window.currentRow)


def so_far():
    return by_symbol().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def full(x: Column, n: int, value: Column) -> Column:
    """``value`` where the last ``n`` bars all carry ``x``.

    Looks at the last bar missing ``x``: a running maximum, shared by every
    window length over the same ``x``, instead of a count per window.
    """
    gap = F.max(F.when(x.isNull(), F.col(BAR))).over(so_far())
    return F.when(F.col(BAR) - F.coalesce(gap, F.lit(0)) >= n, value)


def ts_mean(x: Column, n: int) -> Column:
    return full(x, n, F.avg(x).over(trailing(n)))


def ts_sum(x: Column, n: int) -> Column:
    return full(x, n, F.sum(x).over(trailing(n)))


def ts_std(x: Column, n: int) -> Column:
    return full(x, n, F.stddev_samp(x).over(trailing(n)))


def ts_max(x: Column, n: int) -> Column:
    return full(x, n, F.max(x).over(trailing(n)))


def ts_min(x: Column, n: int) -> Column:
    return full(x, n, F.min(x).over(trailing(n)))


def ts_rank(x: Column, n: int) -> Column:
    """Share of the other n-1 bars strictly below the current one."""
    if n < 2:
        return F.lit(None).cast("double")
    seen = F.collect_list(x).over(trailing(n))
    below = F.size(F.filter(seen, lambda v: v < x))
    return full(x, n, below / F.lit(float(n - 1)))


def ts_argmax(x: Column, n: int) -> Column:
    """Bars since the window's maximum; among equals the oldest counts."""
    best = F.max(F.struct(x.alias("v"), (-F.col(BAR)).alias("k"))).over(trailing(n))
    return full(x, n, (F.col(BAR) + best["k"]).cast("double"))


def ts_argmin(x: Column, n: int) -> Column:
    best = F.min(F.struct(x.alias("v"), F.col(BAR).alias("k"))).over(trailing(n))
    return full(x, n, (F.col(BAR) - best["k"]).cast("double"))


def _pairs(x: Column, y: Column) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), 1)


def ts_corr(x: Column, y: Column, n: int) -> Column:
    return full(_pairs(x, y), n, pearson(x, y, over=trailing(n)))


def ts_cov(x: Column, y: Column, n: int) -> Column:
    return full(_pairs(x, y), n, F.covar_samp(x, y).over(trailing(n)))


def ts_count(x: Column, n: int) -> Column:
    """Positive bars among the last n; short and missing histories count as zeros."""
    return F.sum(F.when(x > 0, 1.0).otherwise(0.0)).over(trailing(n))


def ts_skew(x: Column, n: int) -> Column:
    if n < 3:
        return F.lit(None).cast("double")
    unbias = math.sqrt(n * (n - 1)) / (n - 2)
    return full(x, n, F.coalesce(F.skewness(x).over(trailing(n)) * unbias, F.lit(0.0)))


def ts_kurt(x: Column, n: int) -> Column:
    if n < 4:
        return F.lit(None).cast("double")
    scale = (n - 1) / ((n - 2) * (n - 3))
    raw = F.kurtosis(x).over(trailing(n))
    return full(x, n, F.coalesce(scale * ((n + 1) * raw + 6), F.lit(-3.0)))


def ts_product(x: Column, n: int) -> Column:
    return full(x, n, F.product(x).over(trailing(n)))


def shift(x: Column, n: int) -> Column:
    return F.lag(x, n).over(by_symbol())


def delta(x: Column, n: int) -> Column:
    return x - shift(x, n)


def pct_change(x: Column, n: int) -> Column:
    return ratio(x, shift(x, n)) - 1


def decay_linear(x: Column, n: int) -> Column:
    """Weights 1..n, newest heaviest, as two windowed sums instead of a list per row."""
    k = F.col(BAR).cast("double")
    weighted = F.sum(x * k).over(trailing(n)) - (k - n) * F.sum(x).over(trailing(n))
    return full(x, n, weighted / (n * (n + 1) / 2))


def faded_sum(x: Column, log_rate: float) -> Column:
    """Running sum in which each bar back multiplies a value by exp(log_rate), log_rate < 0.

    Terms are scaled inside blocks of bars short enough for a double's exponent;
    the block before the current one is carried over, older ones weigh below
    exp(-350) and vanish in rounding.
    """
    length = max(1, int(350 / -log_rate))
    block = F.floor((F.col(BAR) - 1) / length)
    step = (F.col(BAR) - 1 - block * length).cast("double")
    scaled = x * F.exp(step * -log_rate)
    here = F.sum(scaled).over(
        Window.partitionBy(SYMBOL, block).orderBy(BAR).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = F.sum(scaled).over(Window.partitionBy(SYMBOL).orderBy(block).rangeBetween(-1, -1))
    zero = F.lit(0.0)
    total = F.coalesce(here, zero) + F.coalesce(before, zero) * math.exp(log_rate * length)
    return total * F.exp(step * log_rate)


def decay_exp(x: Column, n: int) -> Column:
    """Half-life n mean over all bars so far; gaps age the weights, the last value carries over them."""
    rate = -math.log(2.0) / n
    mean = ratio(faded_sum(x, rate), faded_sum(F.when(x.isNotNull(), 1.0), rate))
    known = F.last(F.when(x.isNotNull(), mean), ignorenulls=True).over(so_far())
    return F.when(F.count(x).over(so_far()) >= n, known)
