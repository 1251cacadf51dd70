"""Bar sources: one canonical schema out of each market's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..columns import DATE, SYMBOL

c = F.col

US_NAMES = {"symbol": SYMBOL, "date": DATE, "adj_close": "close"}
CN_NAMES = {"ts_code": SYMBOL, "trade_date": DATE, "vol": "volume", "total_mv": "market_cap", "circ_mv": "circ_market_cap"}


def canonical(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename to canonical columns; NaN becomes NULL, dates become DATE."""
    cols = []
    for f in df.schema.fields:
        out = names.get(f.name, f.name)
        x = c(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            x = F.when(~F.isnan(x), x.cast("double"))
        if out == DATE:
            x = F.to_date(x)
        cols.append(x.alias(out))
    return df.select(*cols)


def us_bars(prices: DataFrame) -> DataFrame:
    """Seven columns; the adjusted close is the close.  Filter and pruning reach the scan."""
    cols = ["symbol", "date", "open", "high", "low", "adj_close", "volume"]
    return canonical(prices.select(*cols).where(c("adj_close") > 0), US_NAMES)


def with_basics(bars: DataFrame, daily_basic: DataFrame) -> DataFrame:
    """Left join of the daily fundamentals on (symbol, date)."""
    extra = ["turnover_rate", "volume_ratio", "pe_ttm", "pb", "ps_ttm", "market_cap", "circ_market_cap"]
    return bars.join(canonical(daily_basic, CN_NAMES).select(SYMBOL, DATE, *extra), [SYMBOL, DATE], "left")


def cn_basic_bars(prices: DataFrame, daily_basic: DataFrame) -> DataFrame:
    return with_basics(canonical(prices, CN_NAMES).where(c("close") > 0), daily_basic)


def cn_bars(prices: DataFrame, daily_basic: DataFrame, moneyflow: DataFrame, margin: DataFrame) -> DataFrame:
    """Bars enriched from three tables.  All sides share the key (symbol, date): one partitioning, three joins."""
    flow = canonical(moneyflow, CN_NAMES).select(
        SYMBOL, DATE, "net_mf_amount", (c("buy_elg_amount") - c("sell_elg_amount")).alias("large_net_in")
    )
    margins = canonical(margin, CN_NAMES).select(SYMBOL, DATE, c("rzye").alias("margin_balance"))
    return (
        cn_basic_bars(prices, daily_basic)
        .join(flow, [SYMBOL, DATE], "left")
        .join(margins, [SYMBOL, DATE], "left")
    )


def security_metadata(symbols: DataFrame) -> DataFrame:
    """symbol, name, type, exchange with defaults for what is missing."""
    return symbols.select(
        SYMBOL,
        F.coalesce("name", SYMBOL).alias("name"),
        F.coalesce("type", F.lit("")).alias("type"),
        F.coalesce("exchange", F.lit("")).alias("exchange"),
    )
