"""Research inputs derived from the given tables: weekly bars per supplier and what hangs on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sigloom.columns import BAR, DATE, FACTOR, SYMBOL, VALUE
from sigloom.functions import cross as C, rolling as R
from sigloom.functions.scalar import ratio
from sigloom.operators import dayscores as DS, panel as P, ranking
from sigloom.operators.longform import long_signals
from sigloom.session import cut

OOS_START = "2000-07-01"

# Folder of an already written bars table per table folder; the bench fills it,
# as a research desk would, so that queries start from stored bars.
STORED_BARS: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def width(spark: SparkSession, sf: str) -> int:
    """Names per date never exceed the supplier table (a row count from the file footers)."""
    return table(spark, sf, "supplier").count()


def traded(li: DataFrame, symbol: str = "l_suppkey", step: str = "week") -> DataFrame:
    return li.withColumns(
        {
            SYMBOL: F.col(symbol).cast("string"),
            DATE: F.trunc(F.to_date("l_shipdate"), step),
            "price": ratio(F.col("l_extendedprice"), F.col("l_quantity")),
        }
    )


def trades(spark: SparkSession, sf: str, symbol: str = "l_suppkey", step: str = "week") -> DataFrame:
    return traded(table(spark, sf, "lineitem"), symbol, step)


#: Trades of one symbol that one task sorts; a busier symbol's trades are combined before they meet.
TRADES_IN_TASK = 5_000_000


def bar_columns() -> dict:
    """What a bar is made of, as aggregates of ``trades``; the trades of one bar are ordered by all that tells them apart."""
    when = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    price = lambda x: ratio(x["l_extendedprice"], x["l_quantity"])
    return {
        "open": price(F.min(when)),
        "high": F.max("price"),
        "low": F.min("price"),
        "close": price(F.max(when)),
        "volume": F.sum("l_quantity"),
        "amount": F.sum("l_extendedprice"),
    }


def bars(spark: SparkSession, sf: str, symbol: str = "l_suppkey", step: str = "week") -> DataFrame:
    """Bars out of trades, combined map-side first: a busy symbol's trades never meet in one task."""
    if sf in STORED_BARS and (symbol, step) == ("l_suppkey", "week"):
        return spark.read.parquet(STORED_BARS[sf])
    made = bar_columns()
    out = trades(spark, sf, symbol, step).groupBy(F.col(symbol).alias("_key"), DATE).agg(*[x.alias(n) for n, x in made.items()])
    return out.select(F.col("_key").cast("string").alias(SYMBOL), DATE, *made)


def gathered(spark: SparkSession, sf: str) -> DataFrame | None:
    """``trades`` dealt out by symbol, so that bars and all windows over them need no further shuffle; None where a symbol is too busy for a task.

    Weekly bars hold few trades each, so combining them before the shuffle saves no rows and makes wide ones.
    """
    li = table(spark, sf, "lineitem")
    if ranking.largest_group(li, ["l_suppkey"]) > TRADES_IN_TASK:
        return None
    # Prices and dates are made behind the shuffle: they need not travel.
    return traded(li.withColumn(SYMBOL, F.col("l_suppkey").cast("string")).repartition(SYMBOL), SYMBOL)


def symbol_bars(spark: SparkSession, sf: str) -> DataFrame:
    """``bars`` of the weeks, dealt out by symbol."""
    rows = None if sf in STORED_BARS else gathered(spark, sf)
    if rows is None:
        return bars(spark, sf)
    return rows.groupBy(SYMBOL, DATE).agg(*[x.alias(n) for n, x in bar_columns().items()])


def store_bars(spark: SparkSession, sf: str, folder: str) -> None:
    """Write the weekly bars, each symbol's history together and in order."""
    bars(spark, sf).repartition(SYMBOL).sortWithinPartitions(SYMBOL, DATE).write.mode("overwrite").parquet(folder)
    STORED_BARS[sf] = folder


def panel(spark: SparkSession, sf: str, spread: bool = False) -> DataFrame:
    return P.index_bars(P.positive_close(symbol_bars(spark, sf)), spread)


def featured(spark: SparkSession, sf: str, spread: bool = False) -> DataFrame:
    return P.with_features(panel(spark, sf, spread))


HORIZONS = (1, 5, 7, 14, 30)


def signal_inputs() -> dict:
    """Inner expressions of the six test factors, each the cross-sectional rank of its input."""
    close, volume = F.col("close"), F.col("volume")
    return {
        "mom": R.delta(R.ts_mean(close, 5), 10),
        "range": R.ts_mean(ratio(F.col("high") - F.col("low"), close), 10),
        "rev": -F.col("ret_5d"),
        "surge": ratio(volume, R.ts_mean(volume, 20)),
        "vol": -R.ts_std(F.col("ret_1d"), 20),
        "vpdiv": -R.ts_corr(close, volume, 20),
    }


FACTORS = ["mom", "range", "rev", "surge", "vol", "vpdiv"]


def wide_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """symbol, date, close, one column per test factor input, forward returns."""
    df = featured(spark, sf)
    ins = signal_inputs()
    return df.select(
        SYMBOL, DATE, BAR, "close", "high", "low", "amount",
        *[ins[f].alias(f) for f in FACTORS],
        *[P.forward_return(h).alias(f"fwd_{h}") for h in HORIZONS],
    )


def stored_inputs(spark: SparkSession, sf: str, targets=("fwd_5",)) -> DataFrame:
    """``wide_inputs`` written once, for queries that read them more than once: bars and windows cost more than all that follows."""
    return cut(wide_inputs(spark, sf).select(SYMBOL, DATE, *FACTORS, *targets))


def signals(spark: SparkSession, sf: str, targets=("fwd_5",), factors=None, wide: DataFrame | None = None) -> DataFrame:
    """Long (factor_id, symbol, date, value, forward returns); value is the percent rank. ``wide``: ``stored_inputs``, where they are at hand."""
    wide = wide_inputs(spark, sf) if wide is None else wide
    if DS.fits(wide, width(spark, sf)):
        return long_signals(rank_columns(spark, sf, targets, factors, wide), factors or FACTORS, keep=list(targets))
    long = long_signals(wide, factors or FACTORS, keep=list(targets))
    ranked = ranking.order_stats(long, [FACTOR, DATE], VALUE, "_r", width(spark, sf))
    return ranked.withColumn(VALUE, ranking.percent_rank("_r")).drop("_r_below", "_r_upto", "_r_n")


def rank_columns(spark: SparkSession, sf: str, targets=("fwd_5",), factors=None, wide: DataFrame | None = None) -> DataFrame:
    """``signals`` with a column per factor: one row per (symbol, date), ranked on its date before any row is multiplied by the factors."""
    wide = wide_inputs(spark, sf) if wide is None else wide
    factors, w = factors or FACTORS, width(spark, sf)
    if not DS.fits(wide, w):
        ranked = C.with_ranks(wide.select(SYMBOL, DATE, *targets, *factors), {f"_r_{f}": f for f in factors})
        return ranked.select(SYMBOL, DATE, *targets, *[F.col(f"_r_{f}").alias(f) for f in factors])
    return DS.percent_ranks(wide.select(SYMBOL, DATE, *targets, *factors), factors, w)


#: The test factors as formulas; ``signals`` computes the same values.
FORMULAS = {
    "mom": "rank(delta(ts_mean(close, 5), 10))",
    "range": "rank(ts_mean((high - low) / close, 10))",
    "rev": "rank(-ret_5d)",
    "surge": "rank(volume / ts_mean(volume, 20))",
    "vol": "rank(-ts_std(ret_1d, 20))",
    "vpdiv": "rank(-ts_corr(close, volume, 20))",
}
