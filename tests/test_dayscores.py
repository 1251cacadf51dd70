import numpy as np
import pytest

from catalog import portfolio, records, scoring, testbed as B
from sigloom.operators import composite as CO, dayscores as DS, ic as IC, panel as P, quintiles as Q, ranking, selection as SE
from sigloom.operators.longform import long_signals
from sigloom.plans import mining as M, report as RP

from helpers import bars, dates


def _wide(spark):
    """Names with ties, gaps of values and of returns, a constant day and a short one."""
    rng = np.random.RandomState(3)
    rows = []
    for d in dates(6):
        for k in range(40 if d != dates(6)[4] else 7):
            a = None if rng.rand() < 0.1 else float(rng.randint(0, 12))
            b = 1.0 if d == dates(6)[2] else float(rng.rand())
            fwd = None if rng.rand() < 0.15 else float(rng.randint(-5, 6))
            rows.append((f"s{k:02d}", d, a, b, fwd))
    return spark.createDataFrame(rows, "symbol string, date date, a double, b double, fwd_5 double")


def _rows(df):
    as_text = lambda v: f"{v:.10f}" if isinstance(v, float) else str(v)
    return sorted(tuple(as_text(r[x]) for x in sorted(df.columns)) for r in df.collect())


def test_columns_score_as_rows_do(spark):
    wide = _wide(spark)
    by_rows = Q.daily_scores(Q.labelled(long_signals(wide, ["a", "b"], keep=["fwd_5"]), "fwd_5", width=40), "fwd_5")
    assert _rows(DS.scores_of(wide, ["a", "b"], "fwd_5", width=40)) == _rows(by_rows)


def test_narrow_batches_change_nothing(spark, monkeypatch):
    wide = _wide(spark)
    whole = _rows(DS.scores_of(wide, ["a", "b"], "fwd_5", width=40))
    monkeypatch.setattr(DS, "DATE_CELLS", 40)
    assert DS.batch_size(40) == 1
    assert _rows(DS.scores_of(wide, ["a", "b"], "fwd_5", width=40)) == whole


def test_the_grid_is_scored_without_a_row_per_candidate(spark):
    rng = np.random.RandomState(0)
    closes = {f"s{k:02d}": list(20 + 10 * rng.rand(130)) for k in range(30)}
    df = P.with_features(P.index_bars(bars(spark, closes), spread=True)).withColumn("fwd_5", P.forward_return(5))
    grid = [x for x in M.factor_grid() if "ts_corr" not in x.formula][::40] + [x for x in M.factor_grid() if len(x.inners) > 1][::30]
    grid = list(dict.fromkeys(grid))
    scored = M.grid_metrics(df, grid, width=30)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Expand" not in plan and "Generate" not in plan
    old = M.mining_metrics(M.grid_signals(df, grid, ["fwd_5"], 30), width=30)
    assert scored.count() == len(grid)
    assert _rows(scored) == _rows(old)


def test_candidates_wider_than_a_batch_keep_their_terms_together():
    grid = list(enumerate(M.factor_grid()))
    batches = M.column_batches([x for _, x in grid], 1)
    assert [i for b in batches for i, _ in b] == [i for i, _ in grid]


def test_diagnosis_of_columns_reads_the_daily_scores_once(spark):
    rng = np.random.RandomState(5)
    rows = [(f"s{k:02d}", d, float(rng.rand()), float(rng.rand()), float(rng.randint(-5, 6))) for d in dates(110) for k in range(32)]
    wide = spark.createDataFrame(rows, "symbol string, date date, a double, b double, fwd_5 double")
    got = RP.column_diagnostics(wide, ["a", "b"], width=32)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan and "Scan ExistingRDD" in plan
    want = RP.market_diagnostics(long_signals(wide, ["a", "b"], keep=["fwd_5"]), width=32)
    assert got.count() == 2 and _rows(got) == _rows(want)


def test_gates_build_their_inputs_once(spark, monkeypatch):
    made = []
    real = B.wide_inputs
    monkeypatch.setattr(B, "wide_inputs", lambda *a: made.append(a) or real(*a))
    scoring.gate_inputs(spark, "/root/testdata/sf0.001")
    assert len(made) == 1


def test_paper_picks_read_stored_inputs(spark, monkeypatch):
    seen = []

    def stop(spark, sf, signals):
        seen.append(signals._jdf.queryExecution().executedPlan().toString())
        raise StopIteration

    monkeypatch.setattr(portfolio, "basket_table", stop)
    with pytest.raises(StopIteration):
        portfolio.paper(spark, "/root/testdata/sf0.001")
    assert "Scan ExistingRDD" in seen[0] and "FileScan" not in seen[0]


def test_ranks_and_ic_of_columns_are_those_of_rows(spark):
    wide = _wide(spark)
    ranked = ranking.order_stats(long_signals(wide, ["a", "b"], keep=["fwd_5"]), ["factor_id", "date"], "value", "_r", 40)
    want = ranked.withColumn("value", ranking.percent_rank("_r")).drop("_r_below", "_r_upto", "_r_n")
    got = DS.percent_ranks(wide, ["a", "b"], 40)
    assert _rows(long_signals(got, ["a", "b"], keep=["fwd_5"])) == _rows(want)
    for least, undefined in ((1, "keep"), (10, "zero"), (10, "drop")):
        by_rows = IC.daily_ic(want, at_least=least, undefined=undefined, width=40)
        assert _rows(DS.column_ic(got, ["a", "b"], "fwd_5", least, undefined, 40)) == _rows(by_rows)


def test_mining_and_candidates_make_no_row_per_factor(spark, monkeypatch):
    """Single ranks are mined, tested and de-duplicated from columns."""
    rng = np.random.RandomState(1)
    closes = {f"s{k:02d}": list(np.abs(50 + np.cumsum(rng.randn(80))) + 5) for k in range(40)}
    panel = P.with_features(P.index_bars(bars(spark, closes))).withColumn("fwd_5", P.forward_return(5))
    grid = [x for x in M.factor_grid() if x.formula in ("rank(-ret_5d)", "rank(-delta(close, 3))", "rank(close)")]
    monkeypatch.setattr(M, "grid_signals", None)
    mined = M.mine(panel, grid, "us", resamples=100, width=40)
    assert mined.count() <= len(grid)


def test_signals_shuffle_a_row_per_bar(spark):
    """Ranks are taken before a bar becomes a row per factor."""
    plan = B.signals(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Expand") < plan.index("FlatMapGroupsInArrow")


def test_votes_of_columns_are_those_of_rows(spark):
    rng = np.random.RandomState(7)
    rows = [(f"s{k:02d}", d, *[None if rng.rand() < 0.05 else float(rng.randint(0, 40)) for _ in range(2)], None if i == 5 else float(rng.rand()), float(rng.randn()))
            for i, d in enumerate(dates(40)) for k in range(60 if i % 9 else 20)]
    wide = spark.createDataFrame(rows, "symbol string, date date, a double, b double, c double, fwd_5 double")
    ranks = DS.percent_ranks(wide, ["a", "b", "c"], 60)
    long = long_signals(ranks, ["a", "b", "c"], keep=["fwd_5"])
    want = CO.voting_composite(long, ["a", "b", "c"], "fwd_5", lookback=30, min_history=5, min_names=30, width=60)
    got = CO.voting_columns(ranks, ["a", "b", "c"], "fwd_5", lookback=30, min_history=5, min_names=30, width=60)
    assert _rows(got) == _rows(want) and got.count() > 1000


@pytest.mark.parametrize("query", [records.promotion_plan, records.promoted_registry, scoring.correlation_dedup, portfolio.composite_ic])
def test_queries_make_their_inputs_once(spark, monkeypatch, query):
    made = []
    real = B.wide_inputs
    monkeypatch.setattr(B, "wide_inputs", lambda *a: made.append(a) or real(*a))
    query(spark, "/root/testdata/sf0.001")
    assert len(made) == 1


def test_baskets_of_columns_are_those_of_rows(spark):
    wide = _wide(spark)
    want = SE.basket_returns(long_signals(wide, ["a", "b"], keep=["fwd_5"]), "fwd_5", 4, 40)
    assert _rows(DS.basket_columns(wide, ["a", "b"], "fwd_5", 4, SE.MIN_NAMES)) == _rows(want)


@pytest.mark.parametrize("query", [portfolio.factor_usage, scoring.ic_by_regime])
def test_schedule_and_regimes_make_their_inputs_once(spark, monkeypatch, query):
    made = []
    real = B.panel
    monkeypatch.setattr(B, "panel", lambda *a: made.append(a) or real(*a))
    query(spark, "/root/testdata/sf0.001")
    assert len(made) == 1
