"""Which symbols may be picked: boards, metadata, price-series quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..columns import DATE, SYMBOL
from ..functions.scalar import ratio
from .indicators import with_atr

c = F.col

# Tradable security types, blocked board prefixes, price-series limits.
ALLOWED_TYPES = [
    "Common Stock", "ADR", "REIT", "PUBLIC", "Foreign Sh.", "NVDR", "GDR", "MLP", "Ltd Part", "CDI", "NY Reg Shrs",
]
BLOCKED_PREFIXES = ["688", "920", "830", "870"]
LIMITS = {
    "recent": 60, "history": 252, "atr_pct": 0.45, "jump": 3.0, "median_low": 0.33, "median_high": 3.0,
}


def tradable_board(symbol: Column) -> Column:
    """No Beijing listings, no blocked code prefixes."""
    return ~F.upper(symbol).rlike(r"\.BJ$|^(" + "|".join(BLOCKED_PREFIXES) + ")")


def price_quality(df: DataFrame, latest: Column, limits: dict | None = None) -> DataFrame:
    """One row per symbol over its last bars up to ``latest``: levels, ratios and reasons to reject.

    ``df`` is the numbered panel; at most ``history`` bars per symbol remain.
    """
    lim = {**LIMITS, **(limits or {})}
    newest = Window.partitionBy(SYMBOL).orderBy(F.desc(DATE))
    prev = F.lag("close").over(Window.partitionBy(SYMBOL).orderBy("bar_no"))
    bars = (
        with_atr(df).withColumn("_jump", ratio(c("close"), prev))
        .where(c(DATE) <= latest)
        .withColumn("_age", F.row_number().over(newest))
        .where(c("_age") <= lim["history"])
    )
    first = c("_age") == 1
    agg = bars.groupBy(SYMBOL).agg(
        F.max(F.when(first, c("close"))).alias("close"),
        F.max(F.when(first, c("atr_14"))).alias("_atr"),
        F.median("close").alias("_hist"),
        F.median(F.when(c("_age") <= lim["recent"], c("close"))).alias("_recent"),
        F.max("_jump").alias("_up"),
        F.min("_jump").alias("_down"),
    )
    close = c("close")
    atr = F.when(c("_atr") > 0, c("_atr")).when(close > 0, close * 0.03)
    jump = F.when(c("_down") > 0, F.greatest(c("_up"), ratio(F.lit(1.0), c("_down")))).otherwise(c("_up"))
    out = agg.withColumns(
        {
            "atr": atr,
            "atr_pct": F.when(close > 0, ratio(atr, close)),
            "median_ratio": F.when(c("_hist") > 0, ratio(c("_recent"), c("_hist"))),
            "max_jump_ratio": F.coalesce(jump, F.lit(1.0)),
        }
    )
    off_centre = (c("median_ratio") < lim["median_low"]) | (c("median_ratio") > lim["median_high"])
    reasons = F.array_compact(
        F.array(
            F.when(close.isNull() | (close <= 0), "invalid_close"),
            F.when(c("atr").isNull() | (c("atr") <= 0), "invalid_atr"),
            F.when(c("atr_pct") > lim["atr_pct"], "atr_too_wide"),
            F.when(off_centre, "price_regime_break"),
            F.when(c("max_jump_ratio") > lim["jump"], "price_gap_break"),
        )
    )
    return out.withColumn("reasons", reasons).select(
        SYMBOL, "close", "atr", "atr_pct", "median_ratio", "max_jump_ratio", "reasons"
    )


def rejection_reason(symbol: Column, type_: Column, known: Column, reasons: Column, allowed: list[str] | None = None) -> Column:
    """First failing check wins; NULL means accepted."""
    listed = F.coalesce(type_, F.lit("")).isin(allowed or ALLOWED_TYPES)
    shown = F.when(F.coalesce(type_, F.lit("")) == "", "unknown").otherwise(type_)
    return (
        F.when(symbol.rlike(r"[=\^]"), "non_equity_symbol")
        .when(~F.coalesce(known, F.lit(False)), "missing_metadata")
        .when(~listed, F.concat(F.lit("unsupported_type: "), shown))
        .when(F.size(reasons) > 0, F.array_join(reasons, " / "))
    )


def accepted_picks(
    picks: DataFrame, metadata: DataFrame, quality: DataFrame, n: int, by: list[str], allowed: list[str] | None = None
) -> DataFrame:
    """Pick rows (few) with their rejection reason and, for the accepted, their place up to ``n``."""
    known = metadata.select(SYMBOL, "name", "type", F.lit(True).alias("_known"))
    judged = picks.join(known, SYMBOL, "left").join(quality.select(SYMBOL, "reasons"), SYMBOL, "left")
    why = rejection_reason(c(SYMBOL), c("type"), c("_known"), c("reasons"), allowed)
    judged = judged.withColumn("rejected", why).drop("_known", "reasons")
    place = F.row_number().over(Window.partitionBy(*by, c("rejected").isNull()).orderBy("rank"))
    return judged.withColumn("place", F.when(c("rejected").isNull(), place)).where(
        c("place").isNull() | (c("place") <= n)
    )
