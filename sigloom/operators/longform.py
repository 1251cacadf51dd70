"""Between one column per factor and one row per (factor, symbol, date)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..columns import DATE, FACTOR, SYMBOL, VALUE


def long_signals(df: DataFrame, factors: list[str], keep: list[str] | None = None) -> DataFrame:
    """Unpivot factor columns; ``keep`` rides along on every row.  No shuffle."""
    ids = [SYMBOL, DATE, *(keep or [])]
    return df.select(*ids, *factors).unpivot(ids, factors, FACTOR, VALUE)


def wide_signals(df: DataFrame, factors: list[str]) -> DataFrame:
    """One column per factor again; rows combine on (symbol, date) map-side."""
    picked = [F.max(F.when(F.col(FACTOR) == f, F.col(VALUE))).alias(f) for f in factors]
    return df.groupBy(SYMBOL, DATE).agg(*picked)
