import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sigloom.operators import ranking as K


def frame(spark, n=900, seed=1):
    rng = np.random.RandomState(seed)
    # one hot group, heavy ties, missing values
    rows = [
        ("hot" if i % 3 else f"g{i % 7}", i, None if i % 11 == 0 else float(rng.randint(0, 40)) if i % 2 else float(rng.randn()))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "g string, i long, v double")


def test_split_path_equals_window_path(spark):
    df = frame(spark)
    plain = K.order_stats(df, ["g"], "v", "r", width=1).toPandas().sort_values("i").reset_index(drop=True)
    split = K.order_stats(df, ["g"], "v", "r", width=10, limit=1).toPandas().sort_values("i").reset_index(drop=True)
    pd.testing.assert_frame_equal(plain, split[plain.columns], check_dtype=False)
    p = K.positions(df, ["g"], [F.col("v"), F.col("i")], "p", "n", width=1).toPandas().sort_values("i").reset_index(drop=True)
    q = K.positions(df, ["g"], [F.col("v"), F.col("i")], "p", "n", width=10, limit=1).toPandas().sort_values("i").reset_index(drop=True)
    pd.testing.assert_frame_equal(p, q[p.columns], check_dtype=False)


def test_average_and_percent_rank_match_pandas(spark):
    df = K.order_stats(frame(spark), ["g"], "v", "r", width=1)
    got = df.select("g", "i", "v", K.average_rank("r").alias("a"), K.percent_rank("r").alias("p")).toPandas().sort_values("i")
    want = got.groupby("g")["v"].rank()
    np.testing.assert_allclose(got["a"], want)
    np.testing.assert_allclose(got["p"], got.groupby("g")["v"].rank(pct=True))


def test_group_size_is_measured_without_a_bound(spark):
    df = frame(spark)
    assert K.largest_group(df, ["g"]) == 600
    assert not K.fits_one_task(df, ["g"], None, limit=599)
    assert K.fits_one_task(df, ["g"], None, limit=600)


def test_quantile_label_matches_qcut(spark):
    rng = np.random.RandomState(3)
    rows = []
    for n in (5, 9, 24, 25, 27, 61, 100):
        rows += [(str(n), i, float(x)) for i, x in enumerate(rng.randn(n))]
    df = K.order_stats(spark.createDataFrame(rows, "g string, i int, v double"), ["g"], "v", "q", width=1)
    got = df.select("g", "v", K.quantile_label("q").alias("q")).toPandas()
    for _, part in got.groupby("g"):
        want = pd.qcut(part["v"], 5, labels=False, duplicates="drop") + 1
        assert (part["q"].values == want.values).all()


def test_top_rows_beyond_the_map_side_limit_is_exact(spark):
    df = spark.range(6000).select(F.lit("hot").alias("g"), F.col("id"), (F.col("id") * 7919 % 6007).cast("double").alias("v"))
    got = K.top_rows(df, ["g"], [F.col("v").desc(), F.col("id")], 1500).toPandas()
    want = df.toPandas().sort_values(["v", "id"], ascending=[False, True]).head(1500)
    assert set(got["id"]) == set(want["id"]) and sorted(got["rank"]) == list(range(1, 1501))
