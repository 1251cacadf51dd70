import datetime as dt

import numpy as np
import pandas as pd

EPOCH = dt.date(2020, 1, 1)


def dates(n):
    return [EPOCH + dt.timedelta(days=i) for i in range(n)]


def bars(spark, closes: dict, missing_volume=False, seed=0):
    """Panel of bars from close lists per symbol; None stays missing."""
    rng = np.random.RandomState(seed)
    rows = []
    for sym, cl in closes.items():
        for d, x in zip(dates(len(cl)), cl):
            v = float(rng.randint(1, 50))
            base = 1.0 if x is None else float(x)
            rows.append((sym, d, base, base * 1.1, base * 0.9, None if x is None else float(x), v))
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


def long(spark, rows):
    """(factor_id, symbol, date, value, fwd_5)."""
    clean = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in rows]
    return spark.createDataFrame(clean, "factor_id string, symbol string, date date, value double, fwd_5 double")


def spearman(a, b):
    return pd.Series(a).rank().corr(pd.Series(b).rank())


def by_key(df, key, col):
    return {r[key]: r[col] for r in df.select(key, col).collect()}
