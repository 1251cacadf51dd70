"""Daily scores of many factors at once: a date's names meet in one task as a matrix, never as a row per factor.

The long form of k factors has k rows per name, each shuffled and sorted twice.
Here a name's k values travel in one row, and ranking a date is k sorts of
plain numbers. The results are those of ``quintiles.daily_scores``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..columns import DATE, FACTOR, SYMBOL
from . import ranking
from .ic import daily_ic
from .longform import long_signals
from .quintiles import GROUPS

c = F.col
#: Values (names x columns) of one date that a task holds; wider tables go in batches of columns.
DATE_CELLS = 32_000_000

_QS = [f"q{k}" for k in range(1, GROUPS + 1)]


def batch_size(width: int | None, most: int = 60) -> int:
    """Columns that one date's matrix may have."""
    return most if width is None else max(1, min(most, DATE_CELLS // max(width, 1)))


def fits(df: DataFrame, width: int | None) -> bool:
    """Whether a date's names fit one task; ``width`` bounds them, without it they are counted."""
    return ranking.fits_one_task(df, [DATE], width)


def _places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many values are smaller, and how many are not larger; NaN is the largest value, as in SQL."""
    order = x.argsort()
    s = x[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1]))
    first = np.flatnonzero(new)
    run = new.cumsum() - 1
    below, upto = np.empty(len(s), np.int64), np.empty(len(s), np.int64)
    below[order] = first[run]
    upto[order] = np.append(first[1:], len(s))[run]
    return below, upto


def _correlation(a: np.ndarray, b: np.ndarray) -> float | None:
    """Of average ranks, whose mean is known exactly; missing where either side is constant."""
    scale = np.sqrt(a @ a) * np.sqrt(b @ b)
    return float(a @ b / scale) if scale > 0 else None


def _values(x: np.ndarray, there: np.ndarray, term: tuple[int, ...], ranks: dict) -> tuple[np.ndarray, np.ndarray]:
    """One column as it is (~i: turned around), or the product of the percent ranks of several."""
    column = lambda i: x[:, i] if i >= 0 else -x[:, ~i]
    known = lambda i: there[:, max(i, ~i)]
    if len(term) == 1:
        return column(term[0]), known(term[0])
    for i in term:
        if i not in ranks:
            own = np.full(len(x), np.nan)
            below, upto = _places(column(i)[known(i)])
            own[known(i)] = (below + upto + 1) / 2.0 / max(len(below), 1)
            ranks[i] = own
    return reduce(lambda a, b: a * b, [ranks[i] for i in term]), reduce(lambda a, b: a & b, [known(i) for i in term])


def _scores(terms: list[tuple[int, ...]], numbers: list[int], k: int, t: int, min_ic: int, schema: pa.Schema, every: bool):
    def run(table: pa.Table) -> pa.Table:
        """The names of one date to a row per factor and target."""
        cells = table.column("x").combine_chunks().flatten()
        x = cells.to_numpy(zero_copy_only=False).reshape(-1, k)
        there = cells.is_valid().to_numpy(zero_copy_only=False).reshape(-1, k)
        ahead = table.column("fwd").combine_chunks().flatten()
        known = ahead.is_valid().to_numpy(zero_copy_only=False).reshape(-1, t)
        ahead = ahead.to_numpy(zero_copy_only=False).reshape(-1, t)
        ranks: dict = {}
        returns: dict = {}
        rows = []
        for number, term in zip(numbers, terms):
            value, has = _values(x, there, term, ranks)
            for at in range(t):
                both = has & known[:, at]
                n = int(both.sum())
                if not n:
                    if every:
                        rows.append((number, at, 0, None, False, *[None] * GROUPS, 0, 0))
                    continue
                # Factors that cover the same names share the ranks of their returns.
                mark = at, both.tobytes()
                if mark not in returns:
                    if len(returns) > 8 * t:
                        returns.clear()
                    y = ahead[both, at]
                    low, high = _places(y)
                    returns[mark] = y, (low + high - n) / 2.0
                y, centred = returns[mark]
                below, upto = _places(value[both])
                ic = _correlation((below + upto - n) / 2.0, centred) if n >= min_ic else None
                q = _quantiles(below)
                size = np.bincount(q, minlength=GROUPS)
                ok = n >= GROUPS * 5 and bool((size > 0).all())
                means = (np.bincount(q, weights=y, minlength=GROUPS) / size).tolist() if ok else [None] * GROUPS
                rows.append((number, at, n, ic, ok, *means, int(size[-1]), int(size[0])))
        columns = list(zip(*rows)) if rows else [()] * len(schema)
        day = [table.column(DATE)[0].as_py()] * len(rows)
        days = pa.array(day, table.schema.field(DATE).type)
        arrays = [pa.array(list(a), f.type) for a, f in zip(columns, schema)]
        return pa.table([arrays[0], days, *arrays[1:]], [FACTOR, DATE, *schema.names[1:]])

    return run


def _quantiles(below: np.ndarray) -> np.ndarray:
    """Labels from 0 out of the counts of smaller values."""
    return sum((below > (len(below) - 1) * j // GROUPS).astype(np.int64) for j in range(1, GROUPS))


def date_rows(df: DataFrame, columns: list[Column], targets: list[str]) -> DataFrame:
    """(symbol, date, fwd, x) of one row per (symbol, date): what all scores of a date are made from, so that they share its shuffle."""
    arrays = [F.array(*[c(f).cast("double") for f in targets]).alias("fwd"), F.array(*[x.cast("double") for x in columns]).alias("x")]
    return df.select(SYMBOL, DATE, *arrays)


def day_scores(
    df: DataFrame, columns: list[Column], terms: list[tuple[int, ...]], target: str | list[str], numbers: list[int] | None = None,
    min_ic: int = 10, every: bool = False, rows: DataFrame | None = None,
) -> DataFrame:
    """``quintiles.daily_scores`` of every factor on every date, from one row per (symbol, date) in ``df``.

    A term names places in ``columns``: one is the factor's value itself, of
    several the percent ranks among the date's names are multiplied; ~i stands
    for the negative of column i, which need not travel as well. factor_id
    is the term's number (its place unless ``numbers`` says otherwise). Of a
    list of targets all are scored where a date's names meet, and ``target``
    says which a row belongs to. ``every`` keeps dates without a pair.
    ``rows``: ``date_rows`` of these, where other scores are made from them as well.
    """
    targets = [target] if isinstance(target, str) else list(target)
    numbers = list(range(len(terms))) if numbers is None else numbers
    day = df.schema[DATE].dataType.simpleString()
    qs = ", ".join(f"{q} double" for q in _QS)
    schema = f"{FACTOR} int, {DATE} {day}, _at int, n_stocks bigint, ic double, spread_ok boolean, {qs}, n_long bigint, n_short bigint"
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.bool_(), *[pa.float64()] * GROUPS, pa.int64(), pa.int64()]
    arrow = pa.schema(list(zip([FACTOR, "_at", "n_stocks", "ic", "spread_ok", *_QS, "n_long", "n_short"], kinds)))
    rows = date_rows(df, columns, targets).drop(SYMBOL) if rows is None else rows
    out = rows.groupBy(DATE).applyInArrow(_scores(terms, numbers, len(columns), len(targets), min_ic, arrow, every), schema)
    if isinstance(target, str):
        return out.drop("_at")
    return out.withColumn("target", F.get(F.array(*[F.lit(f) for f in targets]), c("_at"))).drop("_at")


def scores_of(
    df: DataFrame, factors: list[str], target: str | list[str], width: int | None = None, min_ic: int = 10, every: bool = False
) -> DataFrame:
    """``day_scores`` of the columns ``factors`` under their names, in batches where they are many."""
    size = batch_size(width)
    parts = [
        day_scores(df, [c(f) for f in factors[i : i + size]], [(j,) for j in range(len(factors[i : i + size]))], target,
                   list(range(i, min(i + size, len(factors)))), min_ic, every)
        for i in range(0, len(factors), size)
    ]
    names = F.array(*[F.lit(f) for f in factors])
    return reduce(lambda a, b: a.unionByName(b), parts).withColumn(FACTOR, F.get(names, c(FACTOR)))


def _sides(k: int):
    def run(table: pa.Table) -> pa.Table:
        """The names of one date with a mark per factor: 1 in its lowest quantile, 5 in its highest, else 0; names without a mark are left out."""
        cells = table.column("x").combine_chunks().flatten()
        x = cells.to_numpy(zero_copy_only=False).reshape(-1, k)
        there = cells.is_valid().to_numpy(zero_copy_only=False).reshape(-1, k)
        known = table.column("fwd").combine_chunks().flatten().is_valid().to_numpy(zero_copy_only=False)
        marks = np.zeros((len(x), k), np.int8)
        for i in range(k):
            both = there[:, i] & known
            q = 1 + _quantiles(_places(x[both, i])[0])
            marks[both, i] = np.where((q == 1) | (q == GROUPS), q, 0)
        some = marks.any(axis=1)
        out = table.select([SYMBOL, DATE]).filter(pa.array(some))
        flat = pa.array(marks[some].ravel())
        return out.append_column("marks", pa.ListArray.from_arrays(pa.array(np.arange(some.sum() + 1, dtype=np.int32) * k), flat))

    return run


def side_marks(rows: DataFrame, k: int) -> DataFrame:
    """(symbol, date, marks): who is in either end of which factor, from ``date_rows`` of ``k`` factors and one target."""
    day = rows.schema[DATE].dataType.simpleString()
    return rows.groupBy(DATE).applyInArrow(_sides(k), f"{SYMBOL} string, {DATE} {day}, marks array<tinyint>")


def _products(k: int, min_names: int):
    def run(table: pa.Table) -> pa.Table:
        """The names of one date to sums of products of centred ranks, one row per factor; each pair is ranked within its common names."""
        cells = table.column("x").combine_chunks().flatten()
        x = cells.to_numpy(zero_copy_only=False).reshape(-1, k)
        there = cells.is_valid().to_numpy(zero_copy_only=False).reshape(-1, k)
        used = np.flatnonzero(there.any(axis=0)) if len(x) >= min_names else np.zeros(0, int)
        patterns: dict = {}
        for f in used:
            patterns.setdefault(there[:, f].tobytes(), []).append(f)
        n, (xy, xx, yy) = np.zeros((k, k), np.int64), np.zeros((3, k, k))

        def ranks(both: np.ndarray, own: list[int]) -> np.ndarray:
            made = [_places(x[both, f]) for f in own]
            return np.column_stack([(below + upto - len(below)) / 2.0 for below, upto in made])

        for left in patterns.values():
            for right in patterns.values():
                both = there[:, left[0]] & there[:, right[0]]
                a, b = ranks(both, left), ranks(both, right)
                at = np.ix_(left, right)
                n[at] = both.sum()
                xy[at] = a.T @ b
                xx[at] = (a * a).sum(axis=0)[:, None]
                yy[at] = (b * b).sum(axis=0)[None]
        lists = [pa.array(list(m[used]), pa.list_(t)) for m, t in ((n, pa.int64()), (xy, pa.float64()), (xx, pa.float64()), (yy, pa.float64()))]
        day = pa.array([table.column(DATE)[0].as_py()] * len(used), table.schema.field(DATE).type)
        return pa.table([day, pa.array(used.astype(np.int32)), *lists], [DATE, "a", "n", "xy", "xx", "yy"])

    return run


def rank_products(rows: DataFrame, k: int, min_names: int = 0) -> DataFrame:
    """(date, a, n, xy, xx, yy): sums of products of ranks, from ``date_rows`` of ``k`` factors, a row per factor and date."""
    day = rows.schema[DATE].dataType.simpleString()
    schema = f"{DATE} {day}, a int, n array<bigint>, xy array<double>, xx array<double>, yy array<double>"
    return rows.groupBy(DATE).applyInArrow(_products(k, min_names), schema)


def _ranked(columns: list[str]):
    def run(table: pa.Table) -> pa.Table:
        """The names of one date with percent ranks in place of values."""
        for f in columns:
            at = table.schema.get_field_index(f)
            values = table.column(at).combine_chunks()
            there = values.is_valid().to_numpy(zero_copy_only=False)
            own = np.zeros(len(there))
            below, upto = _places(values.to_numpy(zero_copy_only=False)[there])
            own[there] = (below + upto + 1) / 2.0 / max(len(below), 1)
            table = table.set_column(at, table.schema.field(at), pa.array(own, pa.float64(), mask=~there))
        return table

    return run


def percent_ranks(df: DataFrame, columns: list[str], width: int | None = None) -> DataFrame:
    """``columns`` replaced by their percent ranks among the names of each date; all other columns ride along. The date must fit (``fits``)."""
    size = batch_size(width)
    df = df.withColumns({f: c(f).cast("double") for f in columns})
    for i in range(0, len(columns), size):
        df = df.groupBy(DATE).applyInArrow(_ranked(columns[i : i + size]), df.schema)
    return df


def _labelled(columns: list[str]):
    def run(table: pa.Table) -> pa.Table:
        """The names of one date with quantile labels of their values beside them."""
        for f in columns:
            values = table.column(f).combine_chunks()
            there = values.is_valid().to_numpy(zero_copy_only=False)
            own = np.zeros(len(there), np.int32)
            below, _ = _places(values.to_numpy(zero_copy_only=False)[there])
            own[there] = 1 + sum((below > (len(below) - 1) * j // GROUPS).astype(np.int32) for j in range(1, GROUPS))
            at = table.schema.get_field_index(f"_q_{f}")
            table = table.set_column(at, table.schema.field(at), pa.array(own, pa.int32(), mask=~there))
        return table

    return run


def quantile_columns(df: DataFrame, columns: list[str], width: int | None = None) -> DataFrame:
    """A quantile label ``_q_<column>`` (``ranking.quantile_label``) beside each of ``columns`` on each date, which must fit (``fits``)."""
    size = batch_size(width)
    df = df.withColumns({f"_q_{f}": F.lit(None).cast("int") for f in columns})
    for i in range(0, len(columns), size):
        df = df.groupBy(DATE).applyInArrow(_labelled(columns[i : i + size]), df.schema)
    return df


def ic_of(days: DataFrame, at_least: int = 10, undefined: str = "drop") -> DataFrame:
    """``ic.daily_ic`` out of day scores whose ``min_ic`` is at most ``at_least``."""
    keys = [x for x in days.columns if x in (FACTOR, "horizon", DATE)]
    out = days.where(c("n_stocks") >= at_least).select(*keys, "ic", "n_stocks")
    if undefined == "drop":
        return out.where(c("ic").isNotNull())
    if undefined == "zero":
        return out.withColumn("ic", F.coalesce("ic", F.lit(0.0)))
    return out


def column_ic(
    df: DataFrame, factors: list[str], target: str = "fwd_5", at_least: int = 10, undefined: str = "drop", width: int | None = None
) -> DataFrame:
    """``ic.daily_ic`` of factors that are columns of one row per (symbol, date)."""
    if not fits(df, width):
        long = long_signals(df, factors, keep=[target])
        return daily_ic(long, target, at_least=at_least, undefined=undefined, width=width)
    return ic_of(scores_of(df, factors, target, width, min_ic=at_least), at_least, undefined)


def _baskets(factors: list[str], ret: str, n: int, least: int, picks: list[str] | None, mean_of: str | None):
    def run(table: pa.Table) -> pa.Table:
        """The names of one date to a row per factor: means of both ends, symbol breaks ties; with ``picks`` the names themselves."""
        names = np.empty(table.num_rows, np.int64)
        names[pc.sort_indices(table.column(SYMBOL)).to_numpy()] = np.arange(table.num_rows)
        known = table.column(ret).combine_chunks()
        there, fwd = known.is_valid().to_numpy(zero_copy_only=False), known.to_numpy(zero_copy_only=False)
        rows, ours = [], []
        for i, f in enumerate(factors):
            values = table.column(f).combine_chunks()
            has = values.is_valid().to_numpy(zero_copy_only=False)
            values = values.to_numpy(zero_copy_only=False)
            both = has & there
            below, _ = _places(values[both])
            y, own, ends = fwd[both], names[both], [None, None]
            if len(y) >= least:
                ends = [float(y[np.lexsort((own, sign * below))[:n]].mean()) for sign in (-1, 1)]
            rows.append((i, table.num_rows, len(y), *ends))
            if picks is not None:
                at = np.flatnonzero(has)
                below, _ = _places(values[at])
                own = []
                for side, sign in (("top", -1), ("bot", 1)):
                    first = at[np.lexsort((names[at], sign * below))[:n]]
                    own += [{"side": side, "rank": k + 1} | r for k, r in enumerate(table.select([SYMBOL, *picks]).take(first).to_pylist())]
                ours.append(own)
        day = pa.array([table.column(DATE)[0].as_py()] * len(rows), table.schema.field(DATE).type)
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        number, *rest = [pa.array(list(a), t) for a, t in zip(zip(*rows), kinds)]
        out = pa.table([number, day, *rest], [FACTOR, DATE, "rows", "names", "top", "bot"])
        if picks is None:
            return out
        kept = [(x, table.schema.field(x).type) for x in (SYMBOL, *picks)]
        made = out.append_column("picks", pa.array(ours, pa.list_(pa.struct([("side", pa.string()), ("rank", pa.int32()), *kept]))))
        market = table.column(mean_of).drop_null().to_numpy() if mean_of else []
        mean = float(market.mean()) if len(market) else None
        return made.append_column("mean", pa.array([mean] * len(rows), pa.float64()))

    return run


def basket_columns(
    df: DataFrame, factors: list[str], ret: str, n: int, least: int, picks: list[str] | None = None, mean_of: str | None = None
) -> DataFrame:
    """``selection.basket_returns`` of factors that are columns of one row per (symbol, date); the date must fit (``fits``).

    With ``picks`` the rows of ``selection.both_ends`` ride along as an array, with these columns of theirs: 2 * n a factor and date.
    ``mean``, then, is the mean of ``mean_of``, one of them, over all names of the date.
    """
    day = df.schema[DATE].dataType.simpleString()
    keep = [c(x) for x in dict.fromkeys(picks or [])]
    rows = df.select(SYMBOL, DATE, c(ret).cast("double").alias(ret), *keep, *[c(f).cast("double").alias(f) for f in factors])
    schema = f"{FACTOR} int, {DATE} {day}, rows bigint, names bigint, top double, bot double"
    if picks is not None:
        fields = "".join(f", {x}: {df.schema[x].dataType.simpleString()}" for x in picks)
        schema += f", picks array<struct<side: string, rank: int, {SYMBOL}: string{fields}>>, mean double"
    out = rows.groupBy(DATE).applyInArrow(_baskets(factors, ret, n, least, picks, mean_of), schema)
    return out.withColumn(FACTOR, F.get(F.array(*[F.lit(f) for f in factors]), c(FACTOR)))
