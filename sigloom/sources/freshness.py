"""Is the data there: latest dates, expected dates, coverage of a trading calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..columns import DATE, SYMBOL

c = F.col


def latest_date(df: DataFrame) -> DataFrame:
    return df.agg(F.max(DATE).alias("latest"))


def new_york_day(utc: Column) -> Column:
    """Calendar day in New York of a UTC timestamp, with or without a zone of its own (the session's is UTC)."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), utc.cast("timestamp_ntz")))


def readiness(df: DataFrame, expected: Column | None = None) -> DataFrame:
    """latest, expected and ready; without an expectation the latest date is good enough."""
    wanted = c("latest") if expected is None else expected
    return latest_date(df).withColumn("expected", wanted).withColumn(
        "ready", F.coalesce(c("latest") >= c("expected"), F.lit(False))
    )


def coverage(df: DataFrame, calendar: DataFrame, minimum: int) -> DataFrame:
    """Calendar dates whose number of symbols is zero (missing) or under ``minimum`` (sparse)."""
    counts = df.groupBy(DATE).agg(F.countDistinct(SYMBOL).alias("n"))
    joined = calendar.select(DATE).distinct().join(counts, DATE, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.where(c("n") < minimum).select(
        DATE, "n", F.when(c("n") == 0, "missing").otherwise("sparse").alias("gap")
    )
