"""Bar panel: numbering, returns, derived features, universe, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..columns import BAR, DATE, SYMBOL
from ..functions import rolling as R
from ..functions.scalar import ratio
from .ranking import top_rows


def positive_close(df: DataFrame) -> DataFrame:
    return df.where(F.col("close") > 0)


def index_bars(df: DataFrame, spread: bool = False) -> DataFrame:
    """Number each symbol's bars; the one shuffle all per-symbol windows then share.

    ``spread`` pins its number of partitions: wanted where every bar is about to
    feed hundreds of expressions or rows, so that partitions are not merged by
    the bars' own small size.
    """
    if spread:
        spark = df.sparkSession
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        df = df.repartition(n, SYMBOL)
    w = Window.partitionBy(SYMBOL).orderBy(DATE)
    return df.withColumn(BAR, F.row_number().over(w))


def bars_around(bars: DataFrame, first: str, last: str, back: int | None, ahead: int = 0) -> DataFrame:
    """The bars that values on the dates from ``first`` to ``last`` depend on: ``back`` bars of each symbol before them, ``ahead`` after.

    A look at the two key columns finds where each symbol's bars have to
    begin and end; the outermost of these dates are constants of the scan, so
    it skips all other files and row groups. Symbols without a bar in between are left out. ``back`` None keeps all
    bars before.
    """
    day = F.col(DATE)
    since, until = F.lit(first).cast("date"), F.lit(last).cast("date")
    keys = bars.select(SYMBOL, DATE)
    there = keys.where((day >= since) & (day <= until)).groupBy(SYMBOL).agg(F.min(DATE).alias("_from"), F.max(DATE).alias("_to"))

    def edge(rows: DataFrame, n: int, order: Column, out: str, pick) -> DataFrame:
        near = rows.withColumn("_k", F.row_number().over(Window.partitionBy(SYMBOL).orderBy(order))).where(F.col("_k") <= n)
        return near.groupBy(SYMBOL).agg(pick(DATE).alias(out))

    spans = there
    if back:
        spans = spans.join(edge(keys.where(day < since), back, F.desc(DATE), "_early", F.min), SYMBOL, "left")
    if ahead:
        spans = spans.join(edge(keys.where(day > until), ahead, F.asc(DATE), "_late", F.max), SYMBOL, "left")
    begin = F.coalesce("_early", "_from") if back else F.col("_from")
    end = F.coalesce("_late", "_to") if ahead else F.col("_to")
    spans = spans.select(SYMBOL, begin.alias("_begin"), end.alias("_end"))
    outer = spans.agg(F.min("_begin").alias("low"), F.max("_end").alias("high")).first()
    if outer["low"] is None:
        return bars.where("false")
    high = day <= F.lit(outer["high"])
    rows = bars.where(high if back is None else high & (day >= F.lit(outer["low"]))).join(spans, SYMBOL)
    inside = day <= F.col("_end")
    return rows.where(inside if back is None else inside & (day >= F.col("_begin"))).drop("_begin", "_end")


def forward_return(h: int, close: str = "close") -> Column:
    c = F.col(close)
    return ratio(F.lead(c, h).over(R.by_symbol()), c) - 1


def with_forward_returns(df: DataFrame, horizons=(1, 5, 10, 20)) -> DataFrame:
    return df.withColumns({f"fwd_{h}": forward_return(h) for h in horizons})


def backward_returns() -> dict[str, Column]:
    return {f"ret_{n}d": R.pct_change(F.col("close"), n) for n in (1, 5, 20)}


def volume_ratio_with_today(n: int = 20) -> Column:
    """Volume over its mean of up to n bars including today."""
    v = F.col("volume")
    return ratio(v, F.avg(v).over(R.trailing(n)))


def vwap() -> Column:
    return ratio(F.col("amount"), F.col("volume"))


def with_features(df: DataFrame) -> DataFrame:
    """Columns a factor may name: returns, volume ratio, vwap where not stored."""
    made = backward_returns() | {"volume_ratio": volume_ratio_with_today()}
    if "vwap" not in df.columns and "amount" in df.columns:
        made["vwap"] = vwap()
    return df.withColumns(made)


def universe(df: DataFrame, n: int, cap: str = "market_cap") -> DataFrame:
    """Largest ``n`` names per date by ``cap``; unknown caps come last, symbol breaks ties."""
    order = [F.col(cap).desc_nulls_last(), F.col(SYMBOL)]
    return top_rows(df, [DATE], order, n, out="_cap_rank").drop("_cap_rank")


MEMBER = "in_universe"


def membership(df: DataFrame, n: int, cap: str = "market_cap") -> DataFrame:
    """Flag (MEMBER) the rows of ``universe``; (symbol, date) is the key. Before numbering, so that one shuffle by symbol follows."""
    top = universe(df.select(SYMBOL, DATE, cap), n, cap).select(SYMBOL, DATE, F.lit(True).alias(MEMBER))
    return df.join(top, [SYMBOL, DATE], "left").withColumn(MEMBER, F.coalesce(MEMBER, F.lit(False)))


def trade_dates(df: DataFrame) -> DataFrame:
    """Distinct dates with their index from 0.  One row per DATE: bounded by the calendar."""
    everything = Window.partitionBy(F.lit(0)).orderBy(DATE)
    return df.select(DATE).distinct().withColumn("date_no", F.row_number().over(everything) - 1)


def by_calendar(df: DataFrame) -> DataFrame:
    """Broadcast a table with one short row per DATE (a DATE has under 4 million values)."""
    return F.broadcast(df)


def in_sample_dates(dates: DataFrame, oos_start: str, embargo: int = 5) -> DataFrame:
    """Indexed dates before ``oos_start`` without the last ``embargo`` of them."""
    before = dates.where(F.col(DATE) < F.lit(oos_start).cast("date"))
    everything = Window.partitionBy(F.lit(0))
    return (
        before.withColumn("_n", F.count(F.lit(1)).over(everything))
        .where((F.col("_n") <= embargo) | (F.col("date_no") < F.col("_n") - embargo))
        .drop("_n")
    )


def last_dates(df: DataFrame, k: int) -> DataFrame:
    """Rows of the last ``k`` dates present."""
    keep = df.select(DATE).distinct().orderBy(F.desc(DATE)).limit(k)
    return df.join(by_calendar(keep), DATE, "left_semi")


def on_dates(df: DataFrame, dates: DataFrame) -> DataFrame:
    return df.join(by_calendar(dates.select(DATE).distinct()), DATE, "left_semi")


def effective_date(df: DataFrame, as_of: str) -> DataFrame:
    """Latest date on or before ``as_of`` (one row)."""
    return df.where(F.col(DATE) <= F.lit(as_of).cast("date")).agg(F.max(DATE).alias(DATE))


def neighbour_dates(df: DataFrame) -> DataFrame:
    """Each date with the trading dates before and after it."""
    w = Window.partitionBy(F.lit(0)).orderBy(DATE)
    return df.select(DATE).distinct().withColumns(
        {"prev_date": F.lag(DATE).over(w), "next_date": F.lead(DATE).over(w)}
    )


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row."""
    key = F.lit(1)
    return df.withColumn("_one", key).join(F.broadcast(one_row.withColumn("_one", key)), "_one").drop("_one")
