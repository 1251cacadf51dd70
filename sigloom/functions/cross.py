"""Per-date operators for cross-sections of any size.

Means and deviations are combined map-side and come back as one row per date
(or date and group); ranks come from a histogram of the date's values and
places inside its ranges.  No task ever holds a whole date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..columns import DATE, SYMBOL
from ..operators import ranking

c = F.col


def _standard(x: Column, mean: Column, sd: Column) -> Column:
    return F.when(F.coalesce(sd, F.lit(0.0)) == 0, x * 0.0).otherwise((x - mean) / sd)


def _ordered(df: DataFrame, wanted: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add columns made of ``ranking.spread_stats`` ("_s") of other columns: ``{"out": ("column", expression)}``.

    Several columns are ranked together, as rows of one long table: a plan
    grows with every ranking of a ranked table. (symbol, date) is the key of ``df``.
    """
    if not wanted:
        return df
    if len(wanted) == 1:
        (out, (column, made)), = wanted.items()
        return ranking.spread_stats(df, [DATE], column, "_s").withColumn(out, made).drop("_s_below", "_s_upto", "_s_n")
    columns = list(dict.fromkeys(column for column, _ in wanted.values()))
    cells = [F.struct(F.lit(i).alias("_of"), c(x).cast("double").alias("_v")) for i, x in enumerate(columns)]
    ranked = ranking.spread_stats(df.select(SYMBOL, DATE, F.inline(F.array(*cells))), [DATE, "_of"], "_v", "_s")
    picked = [F.max(F.when(c("_of") == columns.index(column), made)).alias(out) for out, (column, made) in wanted.items()]
    return df.join(ranked.groupBy(SYMBOL, DATE).agg(*picked), [SYMBOL, DATE]).select(*df.columns, *wanted)


def with_ranks(df: DataFrame, ranks: dict[str, str]) -> DataFrame:
    """Add percent ranks (average ties, over the count of non-missing values): ``{"out": "column"}``."""
    return _ordered(df, {out: (column, ranking.percent_rank("_s")) for out, column in ranks.items()})


def with_quantiles(df: DataFrame, column: str, out: str, groups: int = 5) -> DataFrame:
    """Quantile label 1..groups of ``column`` on each date."""
    return _ordered(df, {out: (column, ranking.quantile_label("_s", groups))})


def with_places(df: DataFrame, ranks: dict[str, str], quantiles: dict[str, tuple[str, int]]) -> DataFrame:
    """``with_ranks`` and ``with_quantiles`` of many columns at once; ``quantiles``: ``{"out": ("column", groups)}``."""
    labels = {out: (column, ranking.quantile_label("_s", groups)) for out, (column, groups) in quantiles.items()}
    return _ordered(df, {out: (column, ranking.percent_rank("_s")) for out, column in ranks.items()} | labels)


def with_zscores(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    stats = df.groupBy(DATE).agg(
        *[F.avg(x).alias(f"_m_{o}") for o, x in columns.items()],
        *[F.stddev_samp(x).alias(f"_s_{o}") for o, x in columns.items()],
    )
    made = {o: _standard(c(x), c(f"_m_{o}"), c(f"_s_{o}")) for o, x in columns.items()}
    return df.join(stats, DATE).select(*df.columns, *[v.alias(o) for o, v in made.items()])


def with_demeaned(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    stats = df.groupBy(DATE).agg(*[F.avg(x).alias(f"_m_{o}") for o, x in columns.items()])
    return df.join(stats, DATE).select(
        *df.columns, *[(c(x) - c(f"_m_{o}")).alias(o) for o, x in columns.items()]
    )


def with_neutralized(df: DataFrame, column: str, group: str, out: str) -> DataFrame:
    """Subtract the mean of (date, group); groups combine map-side, AQE decides the join."""
    means = df.groupBy(c(DATE).alias("_d"), c(group).alias("_g")).agg(F.avg(column).alias("_m"))
    return df.join(means, (c(DATE) == c("_d")) & c(group).eqNullSafe(c("_g")), "left").select(
        *df.columns, (c(column) - c("_m")).alias(out)
    )
