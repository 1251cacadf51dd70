"""Means and covariances of many columns at once, merged as matrices; and order statistics by counting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Groups that a first step merges a key's partial results in.
FAN_IN = 32
#: Numbers that one task holds before it hands its partial results on.
HELD = 4_000_000
#: Ranges that one counting pass tells apart.
BUCKETS = 1024


def _merge(a: list | None, n: float, mean: np.ndarray, spread: np.ndarray) -> list:
    """Two groups' counts, means and centred products as those of both together."""
    if a is None:
        return [n, mean.copy(), spread.copy()]
    total = a[0] + n
    gap = mean - a[1]
    a[2] += spread + np.outer(gap, gap) * (a[0] * n / total)
    a[1] += gap * (n / total)
    a[0] = total
    return a


def _rows(key: str, kind: pa.DataType, held: dict) -> pa.RecordBatch:
    parts = list(held.values())
    return pa.record_batch(
        [pa.array(list(held), kind), pa.array([x[0] for x in parts], pa.int64()),
         pa.array([x[1] for x in parts], pa.list_(pa.float64())), pa.array([x[2].ravel() for x in parts], pa.list_(pa.float64()))],
        [key, "n", "mean", "spread"],
    )


def _partial(key: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            keys = batch.column(key).dictionary_encode()
            kind, codes = batch.schema.field(key).type, keys.indices.to_numpy()
            for code, name in enumerate(keys.dictionary.to_pylist()):
                own = x[codes == code]
                mean = own.mean(axis=0)
                centred = own - mean
                held[name] = _merge(held.get(name), len(own), mean, centred.T @ centred)
            if len(held) * k * k > HELD:
                yield _rows(key, kind, held)
                held = {}
        if held:
            yield _rows(key, kind, held)

    return run


def _merged(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key to one row per key; one key is held at a time."""
        name, held = None, None
        for batch in batches:
            kind = batch.schema.field(key).type
            means, spreads = batch.column("mean"), batch.column("spread")
            for i, (now, n) in enumerate(zip(batch.column(key).to_pylist(), batch.column("n").to_pylist())):
                mean = means[i].values.to_numpy()
                if held is not None and now != name:
                    yield _rows(key, kind, {name: held})
                    held = None
                name, held = now, _merge(held, n, mean, spreads[i].values.to_numpy().reshape(len(mean), -1))
        if held is not None:
            yield _rows(key, kind, {name: held})

    return run


def grouped_moments(df: DataFrame, x: Column, k: int, key: str) -> DataFrame:
    """(key, n, mean, cov) of the rows whose array ``x`` has ``k`` values: k means, and k * k population covariances in rows.

    A task merges its rows into one matrix per key, some of a key's matrices
    meet in each of FAN_IN groups, and those meet at last; the plan's size
    does not depend on k. Rows without a key or with a missing value are left out.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n bigint, mean array<double>, spread array<double>"
    rows = df.select(key, x.alias("x")).where(F.col(key).isNotNull() & F.forall("x", lambda v: v.isNotNull()))
    out = rows.mapInArrow(_partial(key, k), schema)
    deal = F.pmod(F.spark_partition_id(), F.lit(FAN_IN))
    out = out.withColumn("_deal", deal).repartition(key, "_deal").drop("_deal").sortWithinPartitions(key).mapInArrow(_merged(key), schema)
    out = out.repartition(key).sortWithinPartitions(key).mapInArrow(_merged(key), schema)
    return out.select(key, "n", "mean", F.transform("spread", lambda s: s / F.col("n")).alias("cov"))


def moment_matrix(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, population covariances) of the rows with all ``columns``: one job, k * k + k + 1 numbers back."""
    k = len(columns)
    x = F.array(*[F.col(c).cast("double") for c in columns])
    got = grouped_moments(df.withColumn("_all", F.lit(0)), x, k, "_all").first()
    if got is None:
        return 0, np.zeros(k), np.zeros((k, k))
    return int(got["n"]), np.array(got["mean"]), np.array(got["cov"]).reshape(k, k)


def order_statistics(df: DataFrame, value: Column, places: list[int] | None = None, middle: bool = False) -> list[float]:
    """The values at these places (from 0) of all rows in order, or the one or two in the middle; missing values aside.

    Each pass counts rows in BUCKETS ranges of the bounds known so far, all of
    it combined map-side, and goes on inside the range that holds the place. A
    range of one value ends it, so ties need no sort and no task holds more
    than its own rows and the counts.
    """
    rows = df.select(value.cast("double").alias("v")).where("v IS NOT NULL")
    whole = rows.agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    if not whole["n"]:
        return []
    if middle:
        places = sorted({(whole["n"] - 1) // 2, whole["n"] // 2})
    found: dict[int, float] = {}
    todo = {p: (0, whole["low"], whole["high"]) for p in places}
    while todo:
        open_now: dict[tuple, list[int]] = {}
        for p, (below, low, high) in list(todo.items()):
            if low == high:
                found[p] = low
                del todo[p]
            else:
                open_now.setdefault((below, low, high), []).append(p)
        for (below, low, high), wanted in open_now.items():
            step = F.floor((F.col("v") - low) / (high - low) * BUCKETS)
            inside = rows.where((F.col("v") >= low) & (F.col("v") <= high))
            counts = inside.groupBy(F.least(step, F.lit(BUCKETS - 1)).alias("b")).agg(
                F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
            )
            upto = below
            for r in sorted(counts.collect(), key=lambda r: r["b"]):  # at most BUCKETS rows
                for p in wanted:
                    if upto <= p < upto + r["n"]:
                        todo[p] = (upto, r["low"], r["high"])
                upto += r["n"]
    return [found[p] for p in places]


def median(df: DataFrame, value: Column) -> float | None:
    """Exact median of all rows, by counting."""
    middle = order_statistics(df, value, middle=True)
    return sum(middle) / len(middle) if middle else None
