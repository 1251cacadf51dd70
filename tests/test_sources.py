import datetime as dt
import json
import tempfile

from helpers import bars, dates
from pyspark.sql import functions as F

from sigloom.operators import panel as P
from sigloom.plans import mining as M
from sigloom.plans.evaluate import compute_factor
from sigloom.sources import bars as SB, freshness as FR, logs as LG, tables as ST


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_us_bars_rename_filter_and_clean(spark):
    df = spark.createDataFrame(
        [("A", dt.date(2024, 1, 2), 1.0, float("nan"), 1.0, 5.0, 4.0, 10.0), ("A", dt.date(2024, 1, 3), 1.0, 1.0, 1.0, 5.0, 0.0, 10.0)],
        "symbol string, date date, open double, high double, low double, close double, adj_close double, volume double",
    )
    rows = SB.us_bars(df).collect()
    assert len(rows) == 1 and rows[0]["close"] == 4.0 and rows[0]["high"] is None


def test_scan_pushes_filter_and_prunes(spark):
    path = folder() + "/p"
    spark.range(10).select(
        F.lit("A").alias("symbol"), F.lit("2024-01-02").cast("date").alias("date"),
        *[F.lit(1.0).alias(x) for x in ("open", "high", "low", "close", "adj_close", "volume", "unused")],
    ).write.parquet(path)
    plan = SB.us_bars(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(adj_close,0.0)" in plan and "unused" not in plan


def test_new_york_day_and_readiness(spark):
    # 04:35 in Shanghai is still the evening before in New York
    ts = spark.createDataFrame([("2026-03-31 20:35:00",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    assert ts.select(FR.new_york_day(F.col("t"))).first()[0] == dt.date(2026, 3, 31)
    df = spark.createDataFrame([("A", dt.date(2026, 3, 30))], "symbol string, date date")
    assert FR.readiness(df, F.lit("2026-03-31").cast("date")).first()["ready"] is False
    assert FR.readiness(df, F.lit("2026-03-30").cast("date")).first()["ready"] is True
    assert FR.readiness(df.where("symbol = 'none'")).first()["ready"] is False


def test_coverage_names_missing_and_sparse(spark):
    d = dates(3)
    df = spark.createDataFrame([("A", d[0]), ("B", d[0]), ("A", d[1])], "symbol string, date date")
    got = {r["date"]: r["gap"] for r in FR.coverage(df, spark.createDataFrame([(x,) for x in d], "date date"), 2).collect()}
    assert got == {d[1]: "sparse", d[2]: "missing"}


def test_log_files_drop_broken_lines_and_fill_decisions(spark):
    path = folder()
    runs = [
        {"ts": "2026-04-01T00:00:00", "session_id": "s1", "name": "alpha_keep", "formula": "a", "is_ic_ir": 0.41, "gates": "PASS", "oos": "PASS"},
        {"ts": "2026-04-02T00:00:00", "session_id": "s2", "name": "alpha_revert", "formula": "b", "is_ic_ir": 0.12, "gates": "FAIL"},
    ]
    with open(path + "/runs.jsonl", "w") as f:
        f.write(json.dumps(runs[0]) + "\n{broken\n\n" + json.dumps(runs[1]) + "\n")
    log = LG.session_runs(LG.read_log(spark, path))
    got = {r["name"]: (r["decision"], r["checks_status"], r["status"]) for r in log.collect()}
    assert got == {"alpha_keep": ("keep", "passed", "kept"), "alpha_revert": ("revert", "skipped", "reverted")}
    s = LG.session_summary(log).first()
    assert (s["total_runs"], s["keep_count"], s["revert_count"], s["oos_pass"], s["best_run"]) == (2, 1, 1, 1, "alpha_keep")
    assert s["confidence_score"] is None  # under three runs
    assert [r["name"] for r in LG.on_day(log, "2026-04-01").collect()] == ["alpha_keep"]


def test_append_is_idempotent_per_session(spark):
    path = folder() + "/log"
    exp = spark.createDataFrame([("s1", "rank(a)", None), ("s2", "rank(b)", None)], "session_id string, formula string, oos string")
    oos = spark.createDataFrame([("rank(b)", "PASS")], "formula string, oos string")
    log = exp.where("session_id = 's1'")
    LG.append_log(path, LG.new_rows(log, exp, oos))
    rows = spark.read.json(path).collect()
    assert [(r["session_id"], r["oos"]) for r in rows] == [("s2", "PASS")]
    assert LG.new_rows(spark.read.schema("session_id string, formula string, oos string").json(path).unionByName(log), exp, oos).count() == 0


def test_tables_round_trip_and_slices(spark):
    path = folder()
    assert ST.read_table(spark, path, "health_log").count() == 0
    rows = spark.createDataFrame([("f", "us", "rank(x)")], "factor_id string, market string, formula string")
    reg = ST.conformed(rows, "factor_registry").first()
    assert reg["status"] == "candidate" and reg["direction"] == "long" and reg["health_watch_count"] == 0
    old = spark.createDataFrame([("A", "d1", 1.0), ("B", "d1", 2.0), ("A", "d2", 3.0)], "symbol string, as_of string, value double")
    ST.write_slices(old, path + "/export", ["as_of"])
    ST.write_slices(spark.createDataFrame([("C", "d1", 9.0)], old.schema), path + "/export", ["as_of"])
    got = {(r["symbol"], r["as_of"], r["value"]) for r in spark.read.parquet(path + "/export").collect()}
    assert got == {("C", "d1", 9.0), ("A", "d2", 3.0)}
    up = ST.upsert(old, spark.createDataFrame([("A", "d1", 7.0), ("Z", "d9", None)], old.schema), ["symbol", "as_of"])
    assert {(r["symbol"], r["as_of"]): r["value"] for r in up.collect()} == {
        ("A", "d1"): 7.0, ("B", "d1"): 2.0, ("A", "d2"): 3.0, ("Z", "d9"): None,
    }


def test_fallback_only_when_primary_is_empty(spark):
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([(2,)], "x int")
    assert [r["x"] for r in ST.first_nonempty(a, b).collect()] == [1]
    assert [r["x"] for r in ST.first_nonempty(a.where("x > 5"), b).collect()] == [2]


def test_grid_agrees_with_the_one_by_one_path(spark):
    import numpy as np

    rng = np.random.RandomState(0)
    closes = {f"s{k:02d}": list(20 + 10 * rng.rand(60)) for k in range(12)}
    df = P.with_features(P.index_bars(bars(spark, closes), spread=True))
    chosen = [
        ("(close - low) / (high - low + 0.01)", "-pct_change(close, 5)"),
        ("-ts_std(ret_1d, 5) / (ts_std(ret_1d, 20) + 0.001)",),
        ("ret_5d", "volume / ts_mean(volume, 10)", "close / ts_max(high, 10)"),
    ]
    grid = [x for x in M.factor_grid() if x.inners in chosen]
    assert len(grid) == 3
    got = M.named(M.grid_signals(df, grid, [], width=12), grid).toPandas()
    for cand in grid:
        one = compute_factor(df, cand.formula).toPandas().set_index(["symbol", "date"])["factor_value"].sort_index()
        mine = got[got.factor_id == cand.name].set_index(["symbol", "date"])["value"].sort_index()
        if len(cand.inners) == 1:  # left unranked: same order within each date
            mine = mine.groupby(level="date").rank(pct=True)
        np.testing.assert_allclose(mine.to_numpy(dtype=float), one.to_numpy(dtype=float), rtol=1e-12)


def test_mining_runs_through_all_stages(spark):
    import numpy as np

    rng = np.random.RandomState(1)
    closes = {f"s{k:02d}": list(50 + 10 * rng.rand(120)) for k in range(30)}
    df = P.with_features(P.index_bars(bars(spark, closes), spread=True)).withColumn("fwd_5", P.forward_return(5))
    mirror = {"rank(pct_change(close, 10))", "rank(-pct_change(close, 10))"}
    others = [
        ("ret_5d - shift(ret_5d, 5)",),
        ("(close - ts_min(low, 10)) / (ts_max(high, 10) - ts_min(low, 10) + 0.01)",),
        ("ts_mean((close - open) / (high - low + 0.01), 5)",),
    ]
    grid = [x for x in M.factor_grid() if x.formula in mirror or x.inners in others]
    assert len(grid) == 5
    out = M.mine(df, grid, "cn", resamples=500, width=30).toPandas()
    assert 1 <= len(out) <= 4
    assert (out["p_value"] < 0.01).all() and out["stable_id"].str.startswith("cn_").all()
    # momentum and reversal are mirror images: never both kept
    assert not mirror <= set(out["formula"])
