"""Cross-sectional correlation between factors, redundancy and greedy de-duplication."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..columns import DATE, FACTOR, SYMBOL
from . import dayscores as DS, ranking

c = F.col
#: Cells (names x factors x patterns) that one group of the cross products holds.
GROUP_CELLS = 4_000_000
#: Candidates that one greedy round adds to the ones kept.
STEP = 30

_PRODUCTS = f"{DATE} date, a int, n array<bigint>, xy array<double>, xx array<double>, yy array<double>"
_SUMMARY = "a int, b int, rho_sum double, abs_sum double, days bigint, rows bigint, common bigint"


def missing_patterns(df: DataFrame, factors: list[str]) -> DataFrame:
    """(date, names, pattern, parts): the number of each factor's missing pattern on each date.

    Two factors share a pattern on a date where they have values for the same
    names: equal counts and equal xor of the names' hashes. A factor without
    values has pattern 0. One pass, combined map-side to one row per date and factor.
    """
    values = df.select(DATE, SYMBOL, F.posexplode(F.array(*[c(f).isNotNull() for f in factors])).alias("f", "has"))
    held = F.when(c("has"), F.xxhash64(SYMBOL))
    per = values.groupBy(DATE, "f").agg(
        F.count(F.lit(1)).alias("names"), F.struct(F.count(held).alias("n"), F.bit_xor(held).alias("mark")).alias("mask")
    )
    whole = per.groupBy(DATE).agg(
        F.max("names").alias("names"),
        F.array_sort(F.collect_set(F.when(c("mask.n") > 0, c("mask")))).alias("masks"),
        F.transform(F.array_sort(F.collect_list(F.struct("f", "mask"))), lambda x: x["mask"]).alias("of"),
    )
    pattern = F.transform("of", lambda m: F.array_position("masks", m).cast("int"))
    cells = c("names") * len(factors) * F.greatest(F.size("masks"), F.lit(1))
    return whole.select(DATE, "names", pattern.alias("pattern"), F.ceil(cells / GROUP_CELLS).cast("int").alias("parts"))


def pattern_ranks(df: DataFrame, factors: list[str], patterns: DataFrame, width: int | None = None) -> DataFrame:
    """(date, part, symbol, f, own, within, r): every value's centred rank among the names of each pattern on its date.

    A value is ranked once for each pattern that its name has, so once where
    all factors cover the same names. Average ranks less their mean; the
    ranks of one factor within another's pattern are the ranks within the
    pair's complete rows.
    """
    values = df.select(SYMBOL, DATE, F.array(*[c(f).cast("double") for f in factors]).alias("values")).join(patterns, DATE)
    there = F.filter(F.arrays_zip("values", "pattern"), lambda x: x["values"].isNotNull())
    rows = values.select(
        DATE, SYMBOL, F.pmod(F.xxhash64(SYMBOL), c("parts")).cast("int").alias("part"), "pattern",
        F.array_distinct(F.transform(there, lambda x: x["pattern"])).alias("ours"), F.posexplode("values").alias("f", "v"),
    ).where("v IS NOT NULL")
    rows = rows.select(DATE, "part", SYMBOL, "f", F.get("pattern", c("f")).alias("own"), F.explode("ours").alias("within"), "v")
    ranked = ranking.order_stats(rows, [DATE, "f", "within"], "v", "_r", width)
    centred = (c("_r_below") + c("_r_upto") - c("_r_n")) / 2.0
    return ranked.select(DATE, "part", SYMBOL, "f", "own", "within", centred.alias("r"))


def _products(k: int):
    def run(table: pa.Table) -> pa.Table:
        """Ranks of one date (or a part of its names) to sums of products, one row per factor."""
        f, own, within = (table.column(x).to_numpy() for x in ("f", "own", "within"))
        names = table.column(SYMBOL).combine_chunks().dictionary_encode().indices.to_numpy()
        r = np.zeros((int(within.max()) + 1, names.max() + 1, k))
        r[within, names, f] = table.column("r").to_numpy()
        has = np.zeros((int(own.max()) + 1, names.max() + 1), bool)
        has[own, names] = True
        members = {p: np.unique(f[own == p]) for p in np.unique(own)}
        n, (xy, xx, yy) = np.zeros((k, k), np.int64), np.zeros((3, k, k))
        for p, left in members.items():
            for q, right in members.items():
                both = has[p] & has[q]
                x, y = r[q][both][:, left], r[p][both][:, right]
                at = np.ix_(left, right)
                n[at] = both.sum()
                xy[at] = x.T @ y
                xx[at] = (x * x).sum(axis=0)[:, None]
                yy[at] = (y * y).sum(axis=0)[None]
        used = np.unique(f)
        lists = [pa.array(list(m[used])) for m in (n, xy, xx, yy)]
        day = pa.array([table.column(DATE)[0].as_py()] * len(used), table.schema.field(DATE).type)
        return pa.table([day, pa.array(used.astype(np.int32)), *lists], [DATE, "a", "n", "xy", "xx", "yy"])

    return run


def _summed(at_least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (a, date) to one row per pair: parts of a date are summed, dates averaged as they pass."""
        factor, day, sums, totals = None, None, None, None

        def close_day():
            n, xy, xx, yy = sums
            scale = np.sqrt(xx * yy)
            known = (scale > 0) & (n > 0)
            rho = np.divide(xy, scale, out=np.zeros_like(xy), where=known)
            enough = known & (n >= at_least)
            totals[:] += [rho * enough, np.abs(rho) * enough, enough, n * known, n]

        def close_factor():
            b = np.flatnonzero(totals[4])
            b = b[b != factor]
            counts = [pa.array(totals[i][b].astype(np.int64)) for i in (2, 3, 4)]
            return pa.record_batch(
                [pa.array(np.full(len(b), factor, np.int32)), pa.array(b.astype(np.int32)), pa.array(totals[0][b]), pa.array(totals[1][b]), *counts],
                ["a", "b", "rho_sum", "abs_sum", "days", "rows", "common"],
            )

        for batch in batches:
            arrays = [batch.column(x) for x in ("n", "xy", "xx", "yy")]
            for i, (a, when) in enumerate(zip(batch.column("a").to_pylist(), batch.column(DATE).to_pylist())):
                row = np.array([x[i].values.to_numpy() for x in arrays], float)
                if (a, when) == (factor, day):
                    sums += row
                    continue
                if sums is not None:
                    close_day()
                if a != factor:
                    if totals is not None:
                        yield close_factor()
                    totals = np.zeros((5, row.shape[1]))
                factor, day, sums = a, when, row
        if sums is not None:
            close_day()
            yield close_factor()

    return run


def pair_summary(
    df: DataFrame, factors: list[str], at_least: int = 10, min_names: int = 0, width: int | None = None, rows: DataFrame | None = None
) -> DataFrame:
    """(a, b, rho, abs_rho, rows, common) for all ordered factor pairs: mean daily rank correlation and row counts.

    No row per pair of factors and name exists anywhere: values are ranked
    once per date and missing pattern, the products of a date (or of a part of
    a large one) are a few k x k matrices, and a date's matrices end in one
    running sum per pair. Days with fewer than ``at_least`` common names do
    not count in the means; ``rows`` are the common rows of days with a
    defined correlation, ``common`` of all days. Where ``width`` says that a date fits a task,
    its names meet as one row each; ``rows`` are these (``DS.date_rows`` of the factors), where at hand.
    """
    k = len(factors)
    if width is not None and DS.fits(df, width) and DS.batch_size(width, k) >= k:
        rows = DS.date_rows(df, [c(f) for f in factors], []) if rows is None else rows
        daily = DS.rank_products(rows, k, min_names)
    else:
        patterns = missing_patterns(df, factors).where(c("names") >= min_names)
        ranks = pattern_ranks(df, factors, patterns, width)
        daily = ranks.groupBy(DATE, "part").applyInArrow(_products(k), _PRODUCTS)
    pairs = daily.repartition("a").sortWithinPartitions("a", DATE).mapInArrow(_summed(at_least), _SUMMARY)
    names = F.array(*[F.lit(f) for f in factors])
    return pairs.select(
        F.get(names, c("a")).alias("a"), F.get(names, c("b")).alias("b"), F.try_divide("rho_sum", "days").alias("rho"),
        F.try_divide("abs_sum", "days").alias("abs_rho"), "rows", "common",
    )


def correlation_matrix(
    df: DataFrame, factors: list[str], min_names: int = 20, width: int | None = None
) -> DataFrame:
    """Average daily rank correlation of every factor pair, both halves and the diagonal."""
    frame = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in factors for b in factors]))
    grid = df.sparkSession.range(1).select(frame.alias("p")).select("p.*")
    both = pair_summary(df, factors, min_names=min_names, width=width).select("a", "b", "rho")
    return grid.join(both, ["a", "b"], "left").select(
        "a", "b", F.when(c("a") == c("b"), 1.0).otherwise(F.round(F.coalesce("rho", F.lit(0.0)), 3)).alias("rho")
    )


def redundant_pairs(matrix: DataFrame, threshold: float = 0.7) -> DataFrame:
    return matrix.where((c("a") < c("b")) & (F.abs("rho") >= threshold)).orderBy(F.abs("rho").desc(), "a", "b")


def absolute_correlation(
    df: DataFrame, factors: list[str], min_rows: int = 0, width: int | None = None, against: list[str] | None = None,
    rows: DataFrame | None = None,
) -> DataFrame:
    """Mean absolute daily rank correlation per pair a < b; pairs with ``min_rows`` common rows or fewer give 0.

    With ``against``, pairs one list with the other. ``rows``: as in ``pair_summary``, of all their names in order.
    """
    pairs = pair_summary(df, sorted({*factors, *(against or [])}), width=width, rows=rows).where("rows > 0")
    if against is None:
        pairs = pairs.where("a < b")
    else:
        pairs = pairs.where(c("a").isin(factors) & c("b").isin(against))
    known = F.when(c("rows") > min_rows, F.coalesce("abs_rho", F.lit(0.0))).otherwise(0.0)
    return pairs.select("a", "b", known.alias("abs_corr"))


def largest_correlation(pairs: DataFrame) -> DataFrame:
    """Per candidate ``a``: its highest mean absolute correlation and with whom."""
    return pairs.groupBy(c("a").alias(FACTOR)).agg(
        F.max("abs_corr").alias("max_corr"), F.max_by("b", F.struct("abs_corr", "b")).alias("most_correlated")
    )


def greedy_distinct(
    df: DataFrame, candidates: DataFrame, limit: float = 0.6, keep: int = 30, min_rows: int = 0, width: int | None = None
) -> DataFrame:
    """Best-first walk over columns of ``df``: drop a candidate too correlated with one already kept.

    The walk goes in rounds. Each takes the next STEP candidates and correlates
    them with each other and with the ones kept, at most ``keep`` of them, so a
    round's matrix is of bounded size however many candidates there are, and
    pairs of dropped candidates are never looked at. One row per candidate and
    one per close pair of a round reach the driver.
    """
    order = [r[0] for r in candidates.orderBy(F.desc("score"), FACTOR).select(FACTOR).collect()]
    kept: list[str] = []
    while order and len(kept) < keep:
        now, order = order[:STEP], order[STEP:]
        close = set()
        if len(now) + len(kept) > 1:
            pairs = absolute_correlation(df, now, min_rows, width, against=[*kept, *now])
            close = {(r["a"], r["b"]) for r in pairs.where(c("abs_corr") > limit).select("a", "b").collect()}
        for f in now:
            if len(kept) < keep and not any((f, k) in close for k in kept):
                kept.append(f)
    return candidates.where(c(FACTOR).isin(kept))
