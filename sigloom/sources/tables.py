"""Registry and lifecycle tables: schemas, upserts, slice replacement, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

c = F.col

_METRICS = ", ".join(f"{m}_{h}d double" for m in ("ic", "ic_ir", "mono", "q5_q1") for h in (7, 14, 30))

SCHEMAS = {
    "factor_registry": (
        "factor_id string, market string, name string, hypothesis string, formula string, direction string, "
        f"discovered_at timestamp, {_METRICS}, composite_score double, status string, promoted_at timestamp, "
        "watchlist_at timestamp, retired_at timestamp, retire_reason string, last_health_check timestamp, "
        "rolling_ic_20d double, health_watch_count int"
    ),
    "daily_candidates": (
        "date date, market string, factor_id string, formula string, ic double, ic_ir double, mono double, "
        "q5_q1 double, rank int"
    ),
    "factor_daily_values": "factor_id string, symbol string, date date, value double",
    "health_log": "date date, factor_id string, rolling_ic_20d double, status_before string, status_after string",
    "factor_weights": (
        "as_of date, market string, factor_id string, weight double, source string, created_at timestamp"
    ),
    "pipeline_runs": (
        "as_of date, market string, stage string, candidate_count int, note string, created_at timestamp"
    ),
    "candidate_feedback": (
        "date date, market string, factor_id string, feedback_score double, feedback_multiplier double, "
        "missed_alpha_overlap double, stale_overlap double, false_positive_overlap double, capture_overlap double, "
        "detail_json string"
    ),
    "paper_picks": "as_of date, side string, rank int, symbol string, composite_score double",
    "paper_returns": (
        "as_of date, eval_date date, long_ret double, short_ret double, ls_ret double, benchmark_ret double, "
        "long_excess double, n_long int, n_short int, cum_long double, cum_benchmark double, cum_excess double"
    ),
}

KEYS = {
    "factor_registry": ["factor_id"],
    "daily_candidates": ["date", "market", "factor_id"],
    "factor_daily_values": ["factor_id", "symbol", "date"],
    "health_log": ["date", "factor_id"],
    "factor_weights": ["as_of", "market", "factor_id"],
    "pipeline_runs": ["as_of", "market", "stage"],
    "candidate_feedback": ["date", "market", "factor_id"],
    "paper_picks": ["as_of", "side", "rank"],
    "paper_returns": ["as_of"],
}

DEFAULTS = {"direction": "long", "status": "candidate", "health_watch_count": 0, "source": "agent_regime"}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def conformed(df: DataFrame, name: str) -> DataFrame:
    """Columns of the named table in order and type; absent ones take their default or NULL."""
    types = dict(empty(df.sparkSession, name).dtypes)
    out = []
    for col, t in types.items():
        default = F.lit(DEFAULTS.get(col)) if col in DEFAULTS else F.lit(None)
        x = F.coalesce(c(col), default) if col in df.columns and col in DEFAULTS else c(col) if col in df.columns else default
        out.append(x.cast(t).alias(col))
    return df.select(*out)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The stored table, or an empty one before the first write."""
    try:
        return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc):
            return empty(spark, name)
        raise


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` rows win over ``existing`` ones with the same key: a union and one combine by key.

    Of several new rows with one key the largest stays, compared column by
    column, so the result does not depend on the order of rows.
    """
    cols = existing.columns
    both = existing.withColumn("_v", F.lit(0)).unionByName(new.select(*cols).withColumn("_v", F.lit(1)))
    newest = both.groupBy(*keys).agg(F.max(F.struct("_v", *[x for x in cols if x not in keys])).alias("_r"))
    return newest.select(*keys, "_r.*").select(*cols)  # drops _v


def replace_slice(existing: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """All rows of the slices present in ``new`` give way to its rows."""
    slices = new.select(*on).distinct()
    return existing.join(slices, on, "left_anti").select(*existing.columns).unionByName(new.select(*existing.columns))


def write_slices(df: DataFrame, folder: str, partitions: list[str]) -> None:
    """Overwrite only the partitions ``df`` holds; each is swapped in by the commit, never half-written."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(folder)


def first_nonempty(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """``primary``, or ``fallback`` if it has no row; decided inside the job."""
    some = primary.limit(1).select(F.lit(1).alias("_one"))
    spare = fallback.select(*primary.columns).withColumn("_one", F.lit(1))
    return primary.unionByName(spare.join(F.broadcast(some), "_one", "left_anti").drop("_one"))


def optional(df: DataFrame, name: str, type_: str = "string") -> Column:
    """A column that some versions of a table lack."""
    return c(name) if name in df.columns else F.lit(None).cast(type_)


def feedback_source(postmortem: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Feedback rows in one shape from the current table or, if it has none, the older one."""
    cols = ["symbol", "label", "evaluation_date"]
    rows = postmortem.select(
        *cols, "feedback_action", "feedback_weight",
        optional(postmortem, "action_label").alias("action_label"), optional(postmortem, "detail_json").alias("detail_json"),
    ).where(c("feedback_action").isNotNull() & c("feedback_weight").isNotNull())
    if fallback is None:
        return rows
    old = fallback.select(
        *cols,
        c("factor_feedback_action").alias("feedback_action"),
        c("factor_feedback_weight").alias("feedback_weight"),
        F.lit(None).cast("string").alias("action_label"),
        F.lit(None).cast("string").alias("detail_json"),
    ).where(c("feedback_action").isNotNull() & c("feedback_weight").isNotNull())
    return first_nonempty(rows, old)


def keep_latest(df: DataFrame, keys: list[str], newest: Column) -> DataFrame:
    """Latest row per key by ``newest`` (few versions per key)."""
    w = Window.partitionBy(*keys).orderBy(newest)
    return df.withColumn("_rn", F.row_number().over(w)).where(c("_rn") == 1).drop("_rn")
