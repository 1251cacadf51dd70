"""Order statistics inside groups that may be too large for one task.

A cross-section (all names of one date) has no natural bound.  Up to
``GROUP_ROW_LIMIT`` rows per group a plain window is the best plan: one shuffle
by the group keys.  Beyond that ranks come from ``spread_stats``, a histogram
and places inside its ranges, and positions from a range-partitioned sort; both
spread one hot group over many tasks.  All give identical results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut

GROUP_ROW_LIMIT = 2_000_000
MAP_SIDE_TOP_LIMIT = 1000  # spark.sql.optimizer.windowGroupLimitThreshold
SALTS = 64
#: Ranges of a histogram to an e-fold of the value, and the magnitude below which values share the middle range.
RANGES = 8
RANGE_ORIGIN = 1e12


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest group: a count per key combined map-side, one number back."""
    top = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()
    return int(top["n"] or 0)


def fits_one_task(df: DataFrame, keys: list[str], width: int | None, limit: int | None = None) -> bool:
    """``width`` is a known upper bound of the group size; without one it is measured."""
    limit = GROUP_ROW_LIMIT if limit is None else limit
    return (largest_group(df, keys) if width is None else width) <= limit


def positions(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    out: str = "pos",
    size: str | None = None,
    width: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """1-based position of each row in its group under ``order`` (make it total); ``size`` adds the group's rows."""
    if fits_one_task(df, keys, width, limit):
        group = Window.partitionBy(*keys)
        made = {out: F.row_number().over(group.orderBy(*order)).cast("long")}
        return df.withColumns(made | ({size: F.count(F.lit(1)).over(group)} if size else {}))
    return _global_positions(df, keys, order, out, size)


def _global_positions(df: DataFrame, keys: list[str], order: list[Column], out: str, size: str | None = None) -> DataFrame:
    full_order = [F.col(k) for k in keys] + order
    placed = cut(
        df.repartitionByRange(*full_order)
        .sortWithinPartitions(*full_order)
        .withColumn("_id", F.monotonically_increasing_id())
    ).withColumn("_slice", F.shiftright("_id", 33))
    # One row per group and slice: slices + groups rows in all, at most `slices` per group.
    spans = placed.groupBy(*keys, "_slice").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_offset", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    if size:
        spans = spans.withColumn(size, F.sum("_rows").over(Window.partitionBy(*keys)))
    spans = spans.drop("_rows")
    return (
        placed.join(spans, [*keys, "_slice"])
        .withColumn(out, F.col("_offset") + F.col("_id") - F.col("_first") + 1)
        .drop("_id", "_slice", "_first", "_offset")
    )


def order_stats(
    df: DataFrame,
    keys: list[str],
    value: str,
    prefix: str,
    width: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Add ``{prefix}_below`` (values strictly smaller), ``{prefix}_upto`` (not larger) and ``{prefix}_n``.

    Missing values take no place and get NULLs.
    """
    below, upto, n = f"{prefix}_below", f"{prefix}_upto", f"{prefix}_n"
    v = F.col(value)
    if fits_one_task(df, keys, width, limit):
        group = Window.partitionBy(*keys)
        ordered = group.orderBy(v.asc_nulls_last())
        to_here = ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns(
            {
                below: F.when(v.isNotNull(), F.rank().over(ordered).cast("long") - 1),
                upto: F.when(v.isNotNull(), F.count(v).over(to_here)),
                n: F.count(v).over(group),
            }
        )
    return spread_stats(df, keys, value, prefix)


def value_range(v: Column) -> Column:
    """A whole number that never falls as the value rises: a signed logarithmic scale, RANGES to an e-fold.

    It depends on nothing but the value, so no pass over the data chooses it,
    and a group has at most some thousands of ranges however many rows it has.
    """
    steps = F.floor(F.log(F.abs(v) * RANGE_ORIGIN + 1) * RANGES)
    return F.when(v < 0, -steps).when(v.isNotNull(), steps).otherwise(F.lit(None))


def spread_stats(df: DataFrame, keys: list[str], value: str, prefix: str) -> DataFrame:
    """``order_stats`` of groups of any size in one plan, with no task for a whole group.

    A histogram of the group's values gives the counts below each range, and
    places are found inside the ranges: rows are dealt out by (keys, range), so
    a group that holds most rows is spread over its ranges. The one window
    over a whole group runs over its histogram.
    """
    below, upto, n = f"{prefix}_below", f"{prefix}_upto", f"{prefix}_n"
    v = F.col(value)
    rows = df.withColumn("_range", value_range(v)).repartition(*keys, "_range")
    # Reads every column, as the rows below do, so that both read one exchange.
    whole = F.max(F.xxhash64(*rows.columns)).alias("_whole")
    counts = rows.groupBy(*keys, "_range").agg(F.count(v).alias("_held"), whole).where("_whole IS NOT NULL").drop("_whole")
    group = Window.partitionBy(*keys)
    lower = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"_lower": F.coalesce(F.sum("_held").over(lower), F.lit(0)), n: F.sum("_held").over(group)}).drop("_held")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_range"]]
    joined = rows.alias("l").join(counts.alias("r"), reduce(lambda a, b: a & b, same)).select("l.*", "_lower", n)
    inside = Window.partitionBy(*keys, "_range").orderBy(v)
    to_here = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    placed = joined.withColumns(
        {
            below: F.when(v.isNotNull(), F.col("_lower") + F.rank().over(inside) - 1),
            upto: F.when(v.isNotNull(), F.col("_lower") + F.count(v).over(to_here)),
        }
    )
    return placed.select(*df.columns, below, upto, n)


def average_rank(prefix: str) -> Column:
    """Rank with ties averaged, from ``order_stats`` columns."""
    return (F.col(f"{prefix}_below") + F.col(f"{prefix}_upto") + 1) / 2.0


def percent_rank(prefix: str) -> Column:
    """Average rank over the number of non-missing values, in (0, 1]."""
    return average_rank(prefix) / F.col(f"{prefix}_n")


def quantile_label(prefix: str, groups: int = 5) -> Column:
    """Label 1..groups by linearly interpolated, right-closed quantile edges.

    A value lies above edge k exactly when more than floor((n-1)k/groups) values
    are smaller, so no edge has to be computed.
    """
    label = F.lit(1)
    for k in range(1, groups):
        cutoff = F.floor((F.col(f"{prefix}_n") - 1) * k / groups)
        label = label + F.when(F.col(f"{prefix}_below") > cutoff, 1).otherwise(0)
    return F.when(F.col(f"{prefix}_below").isNotNull(), label)


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str = "rank") -> DataFrame:
    """The first ``n`` rows per group with their place; exact for groups of any size.

    Spark prunes row_number() <= n map-side up to n = 1000.  For larger n the
    group is first cut into salted parts, each keeping its own first n.
    """
    if n > MAP_SIDE_TOP_LIMIT:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(SALTS))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_salt", salt).withColumn("_part", F.row_number().over(part))
        df = df.where(F.col("_part") <= n).drop("_salt", "_part")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(out, place).where(F.col(out) <= n)
