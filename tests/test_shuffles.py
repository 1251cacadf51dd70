"""What queries send from task to task: plans that would fill disks at size."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import portfolio, records, scoring, sources_joins, testbed as B
from sigloom.operators import correlation as CR, dayscores as DS, panel as P, walkforward as WF
from sigloom.functions import formula as FO
from sigloom.operators.longform import long_signals
from sigloom.plans import mining as M

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("query", [sources_joins.universe_factor, sources_joins.universe_top_n])
def test_universe_is_found_without_a_join(spark, monkeypatch, query):
    got = query(spark, SF)
    assert "Join" not in plan(got)
    want = rows(got)
    monkeypatch.setattr(B, "TRADES_IN_TASK", 0)
    assert rows(query(spark, SF)) == want and len(want) > 100


def test_bars_and_windows_share_one_shuffle(spark, monkeypatch):
    got = B.featured(spark, SF).select("symbol", "date", "ret_5d", "high", "open", "volume")
    assert plan(got).count("Exchange") == 1
    want = rows(got)
    monkeypatch.setattr(B, "TRADES_IN_TASK", 0)
    assert rows(B.featured(spark, SF).select("symbol", "date", "ret_5d", "high", "open", "volume")) == want


def counted(monkeypatch, name):
    """Calls of one of the testbed's steps."""
    calls, step = [], getattr(B, name)
    monkeypatch.setattr(B, name, lambda *a, **k: calls.append(name) or step(*a, **k))
    return calls


def test_health_path_makes_bars_once(spark, monkeypatch):
    calls = counted(monkeypatch, "symbol_bars")
    records.health_path(spark, SF)
    assert len(calls) == 1


def test_several_targets_are_scored_in_one_pass(spark):
    wide = B.wide_inputs(spark, SF).select("symbol", "date", "mom", "vol", "fwd_5", "fwd_7").localCheckpoint()
    both = DS.scores_of(wide, ["mom", "vol"], ["fwd_5", "fwd_7"], 100, min_ic=1, every=True)
    assert plan(both).count("FlatMapGroupsInArrow") == 1
    assert both.select("date").distinct().count() == wide.select("date").distinct().count()
    for t in ("fwd_5", "fwd_7"):
        got = both.where((both["target"] == t) & (both["n_stocks"] > 0)).drop("target")
        assert rows(got) == rows(DS.scores_of(wide, ["mom", "vol"], t, 100, min_ic=1))


def test_paper_returns_make_bars_once(spark, monkeypatch):
    calls = counted(monkeypatch, "symbol_bars")
    got = rows(portfolio.paper_returns(spark, "/root/testdata/sf0.01"))
    assert len(calls) == 1 and len(got) > 300
    monkeypatch.setattr(DS, "fits", lambda *a: False)
    assert rows(portfolio.paper_returns(spark, "/root/testdata/sf0.01")) == got


def test_check_gates_make_bars_once(spark, monkeypatch):
    calls = counted(monkeypatch, "symbol_bars")
    scoring.check_gates(spark, SF)
    assert len(calls) == 1


def test_fold_columns_and_products_equal_the_long_form(spark, monkeypatch):
    rng = np.random.RandomState(3)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(200)]
    gone = lambda share: rng.rand() < share
    data = [
        (f"s{s:02d}", d, None if gone(0.1) else float(rng.randint(0, 30)), None if gone(0.3) else rng.randn(), None if gone(0.05) else rng.randn())
        for d in days for s in range(30 if d.day % 9 else 22) if not gone(0.02)
    ]
    wide = spark.createDataFrame(data, "symbol string, date date, a double, b double, fwd_5 double").localCheckpoint()
    folds = WF.fold_dates(P.trade_dates(wide), "2020-07-10", warmup=20, min_test=40).localCheckpoint()
    want = WF.fold_metrics(long_signals(wide, ["a", "b"], ["fwd_5"]), folds, width=40)
    got = rows(WF.fold_columns(wide, ["a", "b"], folds))
    assert got == rows(want) and len(got) == 4
    near = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    pairs = near(CR.pair_summary(wide, ["a", "b"], min_names=22, width=40))
    monkeypatch.setattr(DS, "fits", lambda *a: False)
    assert pairs == near(CR.pair_summary(wide, ["a", "b"], min_names=22, width=40)) and len(pairs) == 2


def test_averages_of_folds_round_as_sql(spark):
    """0.4039 and 0.401 have the mean 0.40244999999999997."""
    cols = "factor_id string, fold int, ic double, ic_ir double, sharpe double, turnover double, monotonicity double"
    df = spark.createDataFrame([("f", 0, 0.1, 0.1, 0.1, 0.4039, 0.1), ("f", 1, 0.1, 0.1, 0.1, 0.401, 0.1)], cols)
    assert WF.walk_forward(df).first()["avg_turnover"] == 0.4024


def test_the_grid_evaluates_a_window_once(spark):
    texts = ["ts_std(close, 5)", "-ts_std(close, 5)", "-ts_std(close, 5) / (ts_std(close, 5) + 0.001)", "-(-close)"]
    assert [FO.unsigned(x) for x in texts] == [
        (texts[0], False), (texts[0], True), ("ts_std(close, 5) / (ts_std(close, 5) + 0.001)", True), ("close", False),
    ]
    panel = B.featured(spark, SF).withColumn("fwd_5", P.forward_return(5))
    days = M.grid_days(panel, [M.Candidate((x,)) for x in texts[:3]], width=100)
    assert plan(days).count("stddev_samp(") == 1


def test_turned_columns_are_scored_as_their_negatives(spark):
    wide = B.wide_inputs(spark, SF).select("symbol", "date", "mom", "vol", "fwd_5").localCheckpoint()
    columns = [F.col("mom"), F.col("vol")]
    got = DS.day_scores(wide, columns, [(~0,), (~1, 0)], "fwd_5")
    want = DS.day_scores(wide, [*columns, -F.col("mom"), -F.col("vol")], [(2,), (3, 0)], "fwd_5")
    assert rows(got) == rows(want)
