"""Element-wise builders.  Missing is NULL and only NULL: nothing here returns NaN."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def number(x) -> Column:
    """A double column from a column or a plain number."""
    return x if isinstance(x, Column) else F.lit(float(x))


def missing_if_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def ratio(a, b) -> Column:
    """a / b, missing where b is zero."""
    return F.try_divide(number(a), number(b))


def rounded(x: Column, digits: int) -> Column:
    """x to ``digits`` decimals as SQL engines do it in doubles: the scaled value, halves away from zero.

    ``F.round`` judges the decimal text of x instead and takes 1971.95 * 0.9 (1774.7549999999999) down.
    """
    scale = 10.0**digits
    y = F.abs(x * scale)
    whole = F.floor(y).cast("double")
    near = F.signum(x) * (whole + F.when(y - whole >= 0.5, 1.0).otherwise(0.0)) / scale
    return F.when(y < 2.0**52, near).otherwise(x)


def absolute(x: Column) -> Column:
    return F.abs(x)


def sign(x: Column) -> Column:
    return F.signum(x)


def log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def power(x: Column, p) -> Column:
    return missing_if_nan(F.pow(number(x), number(p)))


def clamp(x: Column, lo, hi) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, number(lo)), number(hi)))


def larger(x, y) -> Column:
    """Element-wise maximum; a missing side is skipped."""
    return F.greatest(number(x), number(y))


def smaller(x, y) -> Column:
    return F.least(number(x), number(y))


def if_then(cond: Column, a, b) -> Column:
    return F.when(cond > 0, number(a)).otherwise(number(b))


def formula_key(market, formula) -> Column:
    """Short sha-256 key of ``market:formula``."""
    return F.substring(F.sha2(F.concat_ws(":", market, formula), 256), 1, 16)


def stable_factor_id(market, formula) -> Column:
    """``market_`` plus the first twelve hex digits of the formula's sha-1."""
    return F.concat_ws("_", market, F.substring(F.sha1(formula), 1, 12))


def slug(x: Column) -> Column:
    lowered = F.lower(F.trim(x))
    return F.trim(F.regexp_replace(lowered, "[^a-z0-9]+", "-"), F.lit("-"))


def compact_date(text: Column) -> Column:
    """DATE from ``YYYYMMDD`` or ``YYYY-MM-DD`` text."""
    return F.to_date(F.replace(text, F.lit("-"), F.lit("")), "yyyyMMdd")


# --- aggregates -----------------------------------------------------------

def pearson(a: Column, b: Column, over=None) -> Column:
    """Pearson correlation of the complete pairs; NULL where either side is constant.

    ``corr`` raises DIVIDE_BY_ZERO on constant input under ANSI mode, hence the
    quotient of covariance and deviations.
    """
    x = F.when(b.isNotNull(), a)
    y = F.when(a.isNotNull(), b)
    parts = [F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)]
    if over is not None:
        parts = [p.over(over) for p in parts]
    return F.try_divide(parts[0], parts[1] * parts[2])


def share_true(cond: Column) -> Column:
    return F.avg(F.when(cond, 1.0).otherwise(0.0))
