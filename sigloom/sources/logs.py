"""Experiment logs: JSON lines in, decisions out, idempotent appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import moments as MO

c = F.col

SCHEMA = (
    "ts string, session_id string, market string, name string, formula string, is_ic double, is_ic_ir double, "
    "is_sharpe double, is_turnover double, is_monotonicity double, gates string, oos string, checks_status string, "
    "decision string, status string, eval_seconds double, session_branch string, base_ref string, merge_base string"
)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log files by path or glob; broken lines are dropped."""
    return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path)


def parse_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """The same from a text column."""
    kept = [x for x in lines.columns if x != column]
    corrupt = SCHEMA + ", _bad string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = lines.select(*kept, F.from_json(column, corrupt, options).alias("r")).where(
        c("r").isNotNull() & c("r._bad").isNull()
    )
    return parsed.select(*kept, "r.*").drop("_bad")


def decision() -> Column:
    given = F.when(F.coalesce(c("decision"), F.lit("")) != "", c("decision"))
    derived = F.when(c("oos") == "PASS", "keep").when(c("gates") == "PASS", "candidate").otherwise("revert")
    return F.coalesce(given, derived)


def session_runs(log: DataFrame) -> DataFrame:
    """Fill decision, checks_status and status where a run lacks them."""
    blank = lambda x: F.coalesce(c(x), F.lit("")) == ""
    runs = log.withColumn("decision", decision())
    keep = c("decision") == "keep"
    return runs.withColumns(
        {
            "checks_status": F.when(blank("checks_status"), F.when(keep, "passed").otherwise("skipped")).otherwise(
                c("checks_status")
            ),
            "status": F.when(
                blank("status"),
                F.when(keep, "kept").when(c("decision") == "candidate", "candidate").otherwise("reverted"),
            ).otherwise(c("status")),
        }
    )


def on_day(log: DataFrame, day: str) -> DataFrame:
    return log.where(c("ts").startswith(day))


def union_logs(*logs: DataFrame) -> DataFrame:
    out = logs[0]
    for other in logs[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def new_rows(log: DataFrame, experiments: DataFrame, oos: DataFrame) -> DataFrame:
    """Experiments of sessions the log does not hold yet, with the out-of-sample verdict by formula."""
    results = oos.groupBy("formula").agg(F.max("oos").alias("oos"))
    fresh = experiments.drop("oos").join(log.select("session_id").distinct(), "session_id", "left_anti")
    return fresh.join(results, "formula", "left")


def append_log(log_path: str, rows: DataFrame) -> None:
    rows.write.mode("append").json(log_path)


def session_summary(runs: DataFrame) -> DataFrame:
    """Counts by decision and check, the best run and how far it stands out.

    Confidence is abs(best - median) / MAD, from three runs on. Both medians
    are exact and found by counting runs in ranges, so no task holds the log.
    """
    ir = c("is_ic_ir")
    middle = MO.median(runs, ir)
    mad = None if middle is None else MO.median(runs, F.abs(ir - middle))
    agg = runs.agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if(c("decision") == "keep").alias("keep_count"),
        F.count_if(c("decision") == "revert").alias("revert_count"),
        F.count_if(c("decision") == "candidate").alias("candidate_count"),
        F.count_if(c("gates") == "PASS").alias("gates_pass"),
        F.count_if(c("oos") == "PASS").alias("oos_pass"),
        F.max_by("name", F.struct(ir, c("name"))).alias("best_run"),
        F.max(ir).alias("best_ic_ir"),
        F.count(ir).alias("_n"),
    )
    sure = F.round(F.abs(c("best_ic_ir") - middle) / mad, 2) if mad else F.lit(None).cast("double")
    return agg.withColumn("confidence_score", F.when(c("_n") >= 3, sure)).drop("_n")
