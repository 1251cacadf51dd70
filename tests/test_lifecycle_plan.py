import datetime as dt

import numpy as np
import pytest
from helpers import bars, dates
from pyspark.sql import functions as F

from sigloom.operators import health as H, ic as IC, lifecycle as L, panel as P
from sigloom.plans import lifecycle as LP, mining as M
from sigloom.sources import tables as ST

CHECK = "factor_id string, as_of date, rolling_ic_20d double, health_score double, regime_change boolean"


def stepped(state, checks):
    """One check after the other, by the rules as stated."""
    status, n = state
    out = []
    for as_of, ic, score, change in checks:
        if status not in ("promoted", "watchlist"):
            break
        before = status
        sick = ic < 0.005 or score < 0.45 or change
        well = ic >= 0.01 and score >= 0.65 and not change
        if (status == "promoted" and not sick) or (status == "watchlist" and well):
            status, n = "promoted", 0
        else:
            n += 1
            if status == "promoted" and n >= 5:
                status = "watchlist"
            elif status == "watchlist" and n >= 10:
                status = "retired"
        out.append((as_of, ic, before, status, n))
    return out


def test_a_span_of_checks_equals_one_by_one(spark):
    rng = np.random.RandomState(3)
    days = dates(30)
    states = {f"f{i:02d}": (("promoted", "watchlist", "retired")[i % 3], int(i % 7)) for i in range(24)}
    checks = {f: [(d, float(rng.choice([0.0, 0.007, 0.02])), float(rng.choice([0.3, 0.5, 0.9])), bool(rng.rand() < 0.1)) for d in days[: 30 - i]]
              for i, f in enumerate(states)}
    rows = [(f, *x) for f, own in checks.items() for x in own]
    rng.shuffle(rows)
    got = L.health_path(
        spark.createDataFrame([(f, s, n) for f, (s, n) in states.items()], "factor_id string, status string, health_watch_count int"),
        spark.createDataFrame([tuple(r) for r in rows], CHECK),
    ).collect()
    want = {(f, *x) for f in states for x in stepped(states[f], checks[f])}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_checks_of_a_day_see_what_was_known_then(spark):
    rng = np.random.RandomState(5)
    days = dates(90)
    rows = [(f, f"s{k:02d}", d, float(v), float(0.2 * v * (1 if i < 60 else -1) + rng.randn()))
            for f in ("a", "b") for i, d in enumerate(days) for k, v in enumerate(rng.randn(15))]
    df = spark.createDataFrame(rows, "factor_id string, symbol string, date date, value double, fwd_5 double")
    numbered = P.trade_dates(df)
    got = {(r["factor_id"], r["as_of"]): r for r in LP.daily_checks(df, numbered, days=4).collect()}
    assert len(got) == 8
    for back in (0, 3):
        day, upto = days[89 - back], days[89 - back - 5]
        then = df.where(F.col("date") <= F.lit(upto))
        recent = {r["factor_id"]: r["rolling_ic_20d"] for r in L.recent_ic(then).collect()}
        health = {r["factor_id"]: r for r in H.ic_health(IC.daily_ic(then)).collect()}
        for f in "ab":
            assert got[f, day]["rolling_ic_20d"] == pytest.approx(recent[f])
            assert got[f, day]["health_score"] == health[f]["health_score"]
            assert got[f, day]["regime_change"] == health[f]["regime_change"]


def test_one_day_promotes_what_the_steps_choose(spark):
    rng = np.random.RandomState(1)
    closes = {}
    for k in range(60):
        x = [50.0]
        for _ in range(119):
            x.append(max(5.0, 50 + 0.6 * (x[-1] - 50) + 3 * rng.randn()))
        closes[f"s{k:02d}"] = x
    panel = P.with_features(P.index_bars(bars(spark, closes)))
    panel = panel.withColumns({f"fwd_{h}": P.forward_return(h) for h in (5, *LP.HORIZONS)})
    grid = [x for x in M.factor_grid() if x.formula in ("rank(-ret_5d)", "rank(-delta(close, 3))", "rank(volume)", "rank(close)")]
    rows = [("p1", "rank(-ret_1d)", "promoted", "long", 0), ("p2", "rank(ret_20d)", "watchlist", "long", 9), ("p3", "rank(high)", "retired", "long", 0)]
    df = spark.createDataFrame(rows, "factor_id string, formula string, status string, direction string, health_watch_count int")
    registry = ST.conformed(df.withColumn("market", F.lit("us")), "factor_registry")
    feedback = spark.createDataFrame([], "symbol string, label string, evaluation_date date, feedback_action string, feedback_weight double, action_label string, detail_json string")
    day = F.lit(dt.date(2030, 1, 1))
    out = LP.daily_lifecycle(panel, grid, registry, feedback, day, F.current_timestamp(), "us", resamples=200)
    plan = {r["formula"]: r for r in out["plan"].collect()}
    after = {r["formula"]: r for r in out["registry"].collect()}
    assert plan and {f for f, r in plan.items() if r["action"] == "promote"} == {f for f in after if f not in {r[1] for r in rows}}
    assert after["rank(high)"]["status"] == "retired"
    assert all(after[f]["status"] == "promoted" for f, r in plan.items() if r["action"] != "wait")
    ranks = [(r["rank"], r["rank_score"]) for r in out["candidates"].collect()]
    assert [s for _, s in sorted(ranks)] == sorted([s for _, s in ranks], reverse=True)
    assert {r["factor_id"] for r in out["health_log"].collect()} == {"p1", "p2"}
