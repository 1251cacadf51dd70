import numpy as np
import pandas as pd
import pytest

from sigloom.operators import correlation as CR


def panel(spark, days, names, k, holes):
    """Wide factors with ties; ``holes(day, name, factor)`` are missing."""
    rng = np.random.RandomState(k)
    base = rng.randn(days, names, 1) + 0.7 * rng.randn(days, names, k)
    rows = []
    for d in range(days):
        for i in range(names):
            cells = [None if holes(d, i, f) else round(float(base[d, i, f]), 1) for f in range(k)]
            rows.append((f"s{i:03d}", pd.Timestamp("2024-01-01") + pd.Timedelta(days=d), *cells))
    cols = [f"f{f:03d}" for f in range(k)]
    frame = pd.DataFrame(rows, columns=["symbol", "date", *cols]).astype(dict.fromkeys(cols, float))
    wide = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "symbol string, date date, " + ", ".join(f"{x} double" for x in cols))
    return wide, frame, cols


def brute(frame, a, b, at_least):
    """Mean and mean absolute daily Spearman, rows of defined days, all common rows."""
    rho, rows, common = [], 0, 0
    for _, day in frame.groupby("date"):
        both = day[[a, b]].dropna()
        common += len(both)
        x, y = both[a].rank(), both[b].rank()
        if len(both) and x.std(ddof=0) > 0 and y.std(ddof=0) > 0:
            rows += len(both)
            if len(both) >= at_least:
                rho.append(np.corrcoef(x, y)[0, 1])
    return (np.mean(rho) if rho else None, np.mean(np.abs(rho)) if rho else None, rows, common)


def compare(got, frame, pairs, at_least):
    got = {(r["a"], r["b"]): (r["rho"], r["abs_rho"], r["rows"], r["common"]) for r in got.collect()}
    for a, b in pairs:
        want = brute(frame, a, b, at_least)
        if not want[3]:
            assert (a, b) not in got
            continue
        assert got[a, b][2:] == want[2:] and got[b, a] == pytest.approx(got[a, b])
        for x, y in zip(got[a, b][:2], want[:2]):
            assert x == y if y is None else x == pytest.approx(y, abs=1e-9)


@pytest.mark.parametrize("cells", [4_000_000, 300])
def test_every_factor_with_its_own_pattern(spark, monkeypatch, cells):
    monkeypatch.setattr(CR, "GROUP_CELLS", cells)
    wide, frame, cols = panel(spark, 4, 40, 6, lambda d, i, f: (i * 7 + f * 5 + d) % (f + 3) == 0 or (d == 3 and f == 5))
    pairs = [(a, b) for a in cols for b in cols if a < b]
    compare(CR.pair_summary(wide, cols, at_least=10), frame, pairs, 10)


def test_two_hundred_factors_with_uneven_missing_values(spark):
    wide, frame, cols = panel(spark, 3, 50, 200, lambda d, i, f: (f % 5 == 1 and i < 12 + d) or (f % 5 == 2 and i % 9 == 0) or (f == 7 and d > 0))
    rng = np.random.RandomState(1)
    pairs = [tuple(sorted(p)) for p in rng.choice(cols, (60, 2)) if p[0] != p[1]] + [("f001", "f002"), ("f007", "f008")]
    got = CR.pair_summary(wide, cols)
    compare(got, frame, pairs, 10)
    assert got.count() == 200 * 199


def test_no_pair_of_rows_in_the_plan(spark):
    wide, _, cols = panel(spark, 2, 12, 3, lambda d, i, f: False)
    plan = CR.pair_summary(wide, cols)._jdf.queryExecution().optimizedPlan().toString()
    assert "inline" not in plan and plan.count("Join ") == 1


def test_constant_and_empty_factors(spark):
    wide, frame, cols = panel(spark, 2, 12, 3, lambda d, i, f: f == 2)
    wide = wide.selectExpr("symbol", "date", "f000", "0.0D AS f001", "f002")
    got = {(r["a"], r["b"]): r for r in CR.pair_summary(wide, cols).collect()}
    assert set(got) == {("f000", "f001"), ("f001", "f000")}
    assert got["f000", "f001"]["rho"] is None and got["f000", "f001"]["common"] == 24 and got["f000", "f001"]["rows"] == 0
    matrix = {(r["a"], r["b"]): r["rho"] for r in CR.correlation_matrix(wide, cols, min_names=10).collect()}
    assert len(matrix) == 9 and matrix["f002", "f002"] == 1.0 and matrix["f000", "f001"] == 0.0
    assert CR.pair_summary(wide.where("false"), cols).count() == 0


def test_greedy_rounds_equal_one_walk(spark, monkeypatch):
    wide, frame, cols = panel(spark, 3, 40, 14, lambda d, i, f: False)
    scores = [(f, float((i * 5) % 14)) for i, f in enumerate(cols)]
    candidates = spark.createDataFrame(scores, "factor_id string, score double")
    close = lambda a, b, limit: brute(frame, a, b, 10)[1] > limit
    monkeypatch.setattr(CR, "STEP", 4)
    for limit, keep in ((0.66, 30), (0.9, 5)):
        want = []
        for f, _ in sorted(scores, key=lambda x: (-x[1], x[0])):
            if len(want) < keep and not any(close(f, k, limit) for k in want):
                want.append(f)
        got = CR.greedy_distinct(wide, candidates, limit, keep).select("factor_id").collect()
        assert {r[0] for r in got} == set(want) and 1 < len(want)
