import datetime as dt

import numpy as np
import pandas as pd
import pytest
from helpers import bars, dates
from pyspark.sql import functions as F

from sigloom.operators import feedback as FB, ic as IC, lifecycle as L, panel as P, portfolio as PF, quality as QL, selection as SE
from sigloom.session import cut
from sigloom.sources import tables as ST

c = F.col
D = dt.date(2026, 4, 23)


def test_direction_flip_leaves_the_input_unchanged(spark):
    df = spark.createDataFrame([("f", "AAA", D, 1.0), ("f", "BBB", D, -2.0)], "factor_id string, symbol string, date date, value double")
    out = L.orient(df, spark.createDataFrame([("f", "short")], "factor_id string, direction string"))
    assert [r["value"] for r in out.orderBy("symbol").collect()] == [-1.0, 2.0]
    assert [r["value"] for r in df.orderBy("symbol").collect()] == [1.0, -2.0]


def test_weighted_ic_beats_the_stored_direction(spark):
    df = spark.createDataFrame(
        [("long", -0.04, -0.01, 0.01), ("short", 0.03, 0.01, -0.01), ("short", None, None, None), (None, 0.0, 0.0, 0.0)],
        "direction string, ic_7d double, ic_14d double, ic_30d double",
    )
    assert [r[0] for r in df.select(L.resolve_direction(c("direction"))).collect()] == ["short", "long", "short", "long"]


def postmortem(spark, rows):
    cols = "symbol string, label string, evaluation_date date, feedback_action string, feedback_weight double, action_label string, detail_json string"
    return spark.createDataFrame([(s, lab, D, a, w, al, j) for s, lab, a, w, al, j in rows], cols)


def test_feedback_buckets(spark):
    rows = [
        ("AAA", "missed_alpha", "boost_recall", 1.0, None, None),
        ("BBB", "right_but_no_fill", "penalize_stale_chase", 0.8, None, None),
        ("CCC", "false_positive_executable", "penalize_false_positive", 0.7, None, "not json"),
        ("DDD", "won_and_executable", "reward_executable_capture", 0.5, None, "{}"),
    ]
    got = FB.feedback_weights(FB.recent_feedback(ST.feedback_source(postmortem(spark, rows)), F.lit(D)))
    assert {(r["bucket"], r["symbol"], r["weight"]) for r in got.collect()} == {
        ("missed_alpha", "AAA", 1.0), ("stale", "BBB", 0.8), ("false_positive", "CCC", 0.7), ("captured", "DDD", 0.5),
    }


def test_observed_old_and_weightless_rows_are_skipped(spark):
    rows = [
        ("OBS1", "captured", "reward_capture", 0.5, "OBSERVE", None),
        ("OBS2", "captured", "reward_capture", 0.5, None, '{"action_intent": "OBSERVE"}'),
        ("ZERO", "captured", "reward_capture", 0.0, None, None),
        ("TRADE", "won_and_executable", "reward_executable_capture", 0.5, "TRADE", '{"action_intent": "TRADE"}'),
    ]
    df = postmortem(spark, rows)
    assert [r["symbol"] for r in FB.recent_feedback(df, F.lit(D)).collect()] == ["TRADE"]
    assert FB.recent_feedback(df, F.lit(D + dt.timedelta(days=46))).count() == 0


def test_feedback_overlay_is_bounded(spark):
    snap = spark.createDataFrame([("f", "AAA", 3.0), ("f", "BBB", 2.0), ("f", "CCC", 1.0)], "factor_id string, symbol string, value double")
    weights = spark.createDataFrame(
        [("missed_alpha", "AAA", 1.0), ("stale", "BBB", 1.0), ("captured", "CCC", 1.0)], "bucket string, symbol string, weight double"
    )
    cand = spark.createDataFrame([("f", "long", 1.0, 1.0, 0.5)], "factor_id string, direction string, composite_score double, rank_score double, n_eff_shrinkage double")
    r = FB.with_overlay(cand, FB.overlaps(FB.baskets(snap, cand), weights)).first()
    assert r["basket_n"] == 3 and r["missed_alpha_overlap"] == 1.0 and r["false_positive_overlap"] == 0.0
    assert abs(r["feedback_score"] - 0.9) < 1e-9 and 1.0 < r["feedback_multiplier"] <= 1.20


def test_health_transitions(spark):
    rows = [
        ("ok", "promoted", 3, 0.02, 0.9, False), ("dip", "promoted", 1, 0.001, 0.9, False), ("sick", "promoted", 4, 0.02, 0.4, False),
        ("turn", "promoted", 4, 0.02, 0.9, True), ("back", "watchlist", 7, 0.02, 0.7, False), ("wait", "watchlist", 7, 0.006, 0.7, False),
        ("gone", "watchlist", 9, 0.0, 0.7, False),
    ]
    df = spark.createDataFrame(rows, "factor_id string, status string, health_watch_count int, rolling_ic_20d double, health_score double, regime_change boolean")
    got = {r["factor_id"]: (r["status_after"], r["watch_count_after"]) for r in L.health_transition(df).collect()}
    assert got == {
        "ok": ("promoted", 0), "dip": ("promoted", 2), "sick": ("watchlist", 5), "turn": ("watchlist", 5),
        "back": ("promoted", 0), "wait": ("watchlist", 8), "gone": ("retired", 10),
    }


def test_promotion_fills_open_slots_only(spark):
    cand = spark.createDataFrame([(f"c{i}", f"rank(x{i})", i) for i in range(1, 7)], "factor_id string, formula string, rank int")
    reg = spark.createDataFrame(
        [("c1", "rank(x1)", "promoted"), ("old2", "rank(x2)", "retired"), ("k", "other", "promoted")], "factor_id string, formula string, status string"
    )
    act = lambda limit: {r["factor_id"]: r["action"] for r in L.promotion_plan(cand, reg, 3, limit).collect()}
    assert act(30) == {"c1": "refresh", "c2": "repromote", "c3": "promote", "c4": "promote", "c5": "wait", "c6": "wait"}
    assert act(3) == {"c1": "refresh", "c2": "repromote", "c3": "wait", "c4": "wait", "c5": "wait", "c6": "wait"}
    assert set(act(2).values()) == {"refresh", "wait"}


def test_price_quality_and_rejection(spark):
    df = P.index_bars(bars(spark, {"SAFE": [100.0 + i for i in range(8)], "BROKEN": [4000.0] * 7 + [180.0]}))
    got = {r["symbol"]: r["reasons"] for r in QL.price_quality(df, F.lit(dates(8)[-1])).collect()}
    assert got["SAFE"] == [] and "price_gap_break" in got["BROKEN"]
    rows = spark.createDataFrame(
        [("SAFE", "Common Stock", True, []), ("GC=F", "Common Stock", True, []), ("X", None, None, []), ("Y", "ETF", True, []),
         ("Z", "ADR", True, ["a", "b"])], "symbol string, type string, known boolean, reasons array<string>"
    )
    why = rows.select("symbol", QL.rejection_reason(c("symbol"), c("type"), c("known"), c("reasons")).alias("w")).collect()
    assert {r["symbol"]: r["w"] for r in why} == {
        "SAFE": None, "GC=F": "non_equity_symbol", "X": "missing_metadata", "Y": "unsupported_type: ETF", "Z": "a / b",
    }
    code = spark.createDataFrame([("688001.SH",), ("600000.SH",), ("830799.BJ",), ("000001.BJ",)], "s string")
    assert [r["s"] for r in code.where(QL.tradable_board(c("s"))).collect()] == ["600000.SH"]


def test_stop_floor_and_levels(spark):
    df = spark.createDataFrame([("SAFE", 100.0, 300.0, "long")], "symbol string, close double, atr_14 double, direction string")
    assert PF.watch_levels(df, "us").first()["stop"] == 85.0
    r = PF.trade_levels(df, "cn").first()
    assert r["stop"] == 90.0 and r["target"] == 1000.0 and r["rr"] == 90.0
    w = SE.rank_weights(spark.createDataFrame([(1, "p"), (2, "p"), (3, "p")], "rank int, g string"), ["g"]).orderBy("rank").collect()
    assert [round(x["weight"], 6) for x in w] == [0.5, round(1 / 3, 6), round(1 / 6, 6)]


def test_levels_round_halves_of_a_cent_as_sql_does(spark):
    """1971.95 * 0.9 is 1774.7549999999999, whose hundredfold is 177475.5."""
    df = spark.createDataFrame(
        [("L", 1971.9499999999998, 12460.34903050861, "long")], "symbol string, close double, atr_14 double, direction string"
    )
    r = PF.trade_levels(df, "cn").first()
    assert (r["stop"], r["target"], r["rr"]) == (1774.76, 39353.0, 189.57)


def test_export_passes_on_what_its_detail_has_rounded(spark):
    df = spark.createDataFrame(
        [("S", 1747.4, 4172.4961, "short", 0.5)], "symbol string, close double, atr_14 double, direction string, score double"
    )
    priced = PF.trade_levels(df, "cn")
    out = PF.export_rows(priced, F.lit("2001-01-01").cast("date"), {"atr": c("atr")}, keep=("close", "atr_14"))
    r = out.select(F.round("atr_14", 0).alias("once"), F.round(F.get_json_object("detail", "$.atr").cast("double"), 0).alias("twice")).first()
    assert (r["once"], r["twice"]) == (4172.0, 4173.0)


def test_equity_and_drawdown(spark):
    rets = [0.1, -0.5, 0.2, -1.0, 0.3]
    df = spark.createDataFrame([(d, r, 0.0) for d, r in zip(dates(5), rets)], "date date, ret double, benchmark double")
    got = PF.equity_curve(df).orderBy("date").toPandas()
    eq = (1 + pd.Series(rets)).cumprod()
    pd.testing.assert_series_equal(got["equity"], eq, check_names=False)
    pd.testing.assert_series_equal(got["drawdown"], eq / eq.cummax() - 1, check_names=False)


def test_recent_ic_uses_each_factors_own_dates_and_orientation(spark):
    rng = np.random.RandomState(3)
    rows = []
    for f, first, sign in (("early", 0, 1.0), ("late", 60, -1.0)):
        for day in dates(100)[first : first + 40]:
            fwd = rng.randn(12)
            rows += [(f, f"s{k}", day, float(sign * v), float(v)) for k, v in enumerate(fwd)]
    df = spark.createDataFrame(rows, "factor_id string, symbol string, date date, value double, fwd_5 double")
    facing = spark.createDataFrame([("early", "long"), ("late", "short")], "factor_id string, direction string")
    got = {r["factor_id"]: r["rolling_ic_20d"] for r in L.recent_ic(L.orient(df, facing)).collect()}
    assert got["early"] == pytest.approx(1.0) and got["late"] == pytest.approx(1.0)


def test_watched_factors_do_not_meet_in_one_task_each_and_one_series_serves_both_checks(spark):
    rng = np.random.RandomState(4)
    rows = [(f, f"s{k}", day, float(rng.randn()), float(rng.randn())) for f in "ab" for day in dates(30) for k in range(9 if day.day < 3 else 12)]
    df = spark.createDataFrame(rows, "factor_id string, symbol string, date date, value double, fwd_5 double")
    watched = cut(spark.createDataFrame([("a", "long"), ("b", "short")], "factor_id string, direction string"))
    facing = L.watched_signals(df, watched)
    # A stored list has no known size, so a plain join would deal the rows out by factor.
    assert "SortMergeJoin" not in facing._jdf.queryExecution().executedPlan().toString()
    daily = IC.daily_ic(facing, at_least=1, undefined="keep")
    got = {r["factor_id"]: r["rolling_ic_20d"] for r in L.recent_of(daily).collect()}
    assert got == pytest.approx({r["factor_id"]: r["rolling_ic_20d"] for r in L.recent_ic(facing).collect()})
    assert L.usable_ic(daily).count() == IC.daily_ic(facing).count()


def test_only_held_and_watched_factors_are_checked_and_reasons_need_a_change(spark):
    reg = spark.createDataFrame([("a", "promoted"), ("b", "watchlist"), ("c", "retired"), ("d", "candidate")], "factor_id string, status string")
    assert {r["factor_id"] for r in L.under_watch(reg).collect()} == {"a", "b"}
    df = spark.createDataFrame(
        [("gone", "watchlist", 9, 0.0, 0.7, False), ("old", "retired", 3, 0.0, 0.1, True)],
        "factor_id string, status string, health_watch_count int, rolling_ic_20d double, health_score double, regime_change boolean",
    )
    assert {r["factor_id"]: r["retire_reason_after"] for r in L.health_transition(df).collect()} == {"gone": "IC decay", "old": None}


def test_direction_falls_back_to_the_mined_ic(spark):
    rows = [(f, h, 300, 0.0, 0.0, 0.0, 0.0) for f in ("x", "y") for h in (7, 14)]
    m = spark.createDataFrame(rows, "factor_id string, horizon int, rows int, ic_mean double, ic_ir double, monotonicity double, long_short_pct double")
    mined = spark.createDataFrame([("x", -0.03), ("y", 0.02)], "factor_id string, ic double")
    assert {r["factor_id"]: r["direction"] for r in L.multi_horizon(m, mined=mined).collect()} == {"x": "short", "y": "long"}
