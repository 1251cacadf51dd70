import numpy as np
import pandas as pd
from helpers import by_key, dates, long, spearman
from pyspark.sql import functions as F

from sigloom.operators import correlation as CR, ic as IC, panel as P, quintiles as Q, walkforward as WF


def day_rows(d, n, seed, factor="f", flip=1.0):
    rng = np.random.RandomState(seed)
    v, r = rng.randn(n), rng.randn(n)
    return [(factor, f"s{i:03d}", d, float(v[i]), float(flip * v[i] + r[i])) for i in range(n)]


def test_daily_ic_needs_ten_names(spark):
    d = dates(3)
    rows = day_rows(d[0], 9, 1) + day_rows(d[1], 10, 2) + day_rows(d[2], 40, 3)
    rows[12] = rows[12][:3] + (rows[12][3], float("nan"))  # incomplete pair on day 1 leaves nine
    got = by_key(IC.daily_ic(long(spark, rows), width=50), "date", "ic")
    assert set(got) == {d[2]}
    part = [r for r in rows if r[2] == d[2]]
    assert abs(got[d[2]] - spearman([r[3] for r in part], [r[4] for r in part])) < 1e-12


def test_undefined_ic_modes(spark):
    d = dates(1)[0]
    df = long(spark, [("f", f"s{i}", d, 1.0, float(i)) for i in range(12)])
    assert IC.daily_ic(df, width=20).count() == 0
    assert IC.daily_ic(df, width=20, undefined="keep").first()["ic"] is None
    assert IC.daily_ic(df, width=20, undefined="zero").first()["ic"] == 0.0


def test_turnover_chain_breaks_on_a_skipped_date(spark):
    d = dates(4)
    rows = day_rows(d[0], 30, 1) + day_rows(d[1], 24, 2) + day_rows(d[2], 30, 3) + day_rows(d[3], 30, 4)
    got = by_key(Q.long_short(long(spark, rows), width=50), "date", "turnover")
    assert set(got) == {d[0], d[2], d[3]}
    assert got[d[0]] is None and got[d[2]] is None

    def ends(day):
        part = pd.DataFrame([r for r in rows if r[2] == day], columns=list("fsdvr"))
        q = pd.qcut(part["v"], 5, labels=False) + 1
        return set(part["s"][q == 5]), set(part["s"][q == 1])

    (l0, s0), (l1, s1) = ends(d[2]), ends(d[3])
    want = ((1 - len(l1 & l0) / len(l1)) + (1 - len(s1 & s0) / len(s1))) / 2
    assert abs(got[d[3]] - want) < 1e-12


def test_a_date_whose_values_are_all_missing_also_breaks_the_chain(spark):
    d = dates(3)
    gap = [("f", f"s{i:03d}", d[1], float("nan"), 1.0) for i in range(30)]
    got = by_key(Q.long_short(long(spark, day_rows(d[0], 30, 1) + gap + day_rows(d[2], 30, 2)), width=50), "date", "turnover")
    assert got[d[2]] is None


def test_too_few_distinct_values_give_no_spread(spark):
    d = dates(1)[0]
    df = long(spark, [("f", f"s{i}", d, float(i % 3), float(i)) for i in range(40)])
    assert Q.long_short(df, width=50).count() == 0


def test_monotonicity_and_quintile_returns(spark):
    d = dates(1)[0]
    df = long(spark, [("f", f"s{i}", d, float(i), float(i)) for i in range(25)])
    row = Q.quintile_returns(Q.daily_scores(Q.labelled(df, "fwd_5", width=30), "fwd_5")).first()
    assert row["monotonicity"] == 1.0 and row["long_short_pct"] == 2000.0 and row["n_days"] == 1


def test_top_turnover(spark):
    d = dates(3)
    rows = []
    for k, day in enumerate(d):
        rows += [("f", f"s{i}", day, float((i + 2 * k) % 10), 0.0) for i in range(10)]
    got = by_key(Q.top_turnover(long(spark, rows), width=20), "date", "turnover")
    assert got == {d[1]: 1.0, d[2]: 1.0}


def test_identical_factors_correlate_fully(spark):
    d = dates(2)
    rng = np.random.RandomState(0)
    rows = [(f"s{i}", day, float(x), float(x), float(rng.randn())) for day in d for i, x in enumerate(rng.randn(30))]
    df = spark.createDataFrame(rows, "symbol string, date date, a double, b double, z double")
    m = {(r["a"], r["b"]): r["rho"] for r in CR.correlation_matrix(df, ["a", "b", "z"], width=40).collect()}
    assert m["a", "b"] == m["b", "a"] == m["a", "a"] == 1.0 and abs(m["a", "z"]) < 0.6
    red = CR.redundant_pairs(CR.correlation_matrix(df, ["a", "b", "z"], width=40)).collect()
    assert [(r["a"], r["b"]) for r in red] == [("a", "b")]
    cands = spark.createDataFrame([("a", 0.3), ("b", 0.2), ("z", 0.1)], "factor_id string, score double")
    kept = CR.greedy_distinct(df, cands, width=40).select("factor_id")
    assert sorted(r[0] for r in kept.collect()) == ["a", "z"]


def test_fold_dates_split_and_embargo(spark):
    days = spark.createDataFrame([(x,) for x in dates(400)], "date date")
    numbered = P.trade_dates(days.withColumn("symbol", F.lit("a")))
    folds = WF.fold_dates(numbered, str(dates(331)[330])).toPandas()
    # 330 dates before, 5 embargoed, 120 warm-up: 205 left in chunks of 102
    assert folds.groupby("fold").size().to_dict() == {0: 102, 1: 102}
    assert folds["date"].min() == dates(400)[120]
    assert WF.fold_dates(numbered, str(dates(180)[170])).count() == 0


def test_oos_check_returns_only_a_verdict(spark):
    rows = [r for k, d in enumerate(dates(30)) for r in day_rows(d, 30, k)]
    out = WF.oos_check(long(spark, rows), str(dates(30)[10]), "us", width=40)
    assert out.columns == ["factor_id", "oos_pass"] and out.first()["oos_pass"] is True
