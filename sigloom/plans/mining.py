"""Mining a grid of factors: every candidate scored in one job.

Plan: bars are shuffled once by symbol; all inner expressions are window columns
on that partitioning. To score a batch of candidates, its columns travel in one
row per bar to the bar's date, where every candidate is ranked (``dayscores``).
Where signals themselves are wanted, or a date is too large for one task,
candidates are unpivoted to rows (factor, symbol, date, value) and shuffled
once by (factor, date).  Products of ranks take one more shuffle there; each of
their distinct terms is ranked once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from hashlib import md5

from pyspark.sql import DataFrame, functions as F

from ..columns import DATE, FACTOR, SYMBOL, VALUE
from ..functions.formula import formula, shared_calls, unsigned
from ..operators import bootstrap as BS, correlation as CR, gates as G, ic as IC
from ..operators import dayscores as DS, quintiles as Q, ranking
from ..operators.longform import long_signals
from ..session import cut
from .evaluate import masked

c = F.col


@dataclass(frozen=True)
class Candidate:
    """A product of cross-sectional ranks of inner expressions."""

    inners: tuple[str, ...]

    @property
    def name(self) -> str:
        """An identifier that follows from the formula."""
        return "f_" + md5(self.formula.encode()).hexdigest()[:12]

    @property
    def hypothesis(self) -> str:
        return "favours " + " together with ".join(f"high {x}" for x in self.inners)

    @property
    def formula(self) -> str:
        return " * ".join(f"rank({x})" for x in self.inners)


# Inner expressions of the grid.  {f} is a feature, {w} a window,
# {a} and {b} a pair of windows.
FEATURES = ["close", "high", "low", "open", "volume", "ret_1d", "ret_5d", "ret_20d"]
WINDOWS = [3, 5, 10, 20, 60]

SINGLES = [
    "{f}",
    "-{f}",
    "delta({f}, {w})",
    "-delta({f}, {w})",
    "pct_change({f}, {w})",
    "-pct_change({f}, {w})",
    "ts_mean({f}, {w})",
    "ts_std({f}, {w})",
    "-ts_std({f}, {w})",
    "ts_rank({f}, {w})",
    "ts_max({f}, {w}) / {f} - 1",
    "{f} / ts_min({f}, {w}) - 1",
]
PAIRS = [
    ("-ret_5d", "-volume / ts_mean(volume, {w})"),
    ("-ret_5d", "volume / ts_mean(volume, {w})"),
    ("ret_5d", "volume / ts_mean(volume, {w})"),
    ("-ts_corr(close, volume, {w})", "-ret_5d"),
    ("-ts_corr(close, volume, {w})", "ret_5d"),
    ("-ts_std(volume, {w}) / ts_mean(volume, {w})", "volume / ts_mean(volume, 5)"),
    ("-ts_std(ret_1d, {w})", "abs(ret_1d)"),
    ("(close - low) / (high - low + 0.01)", "-ret_5d"),
    ("-(high - close) / (high - low + 0.01)", "ret_5d"),
    ("-pct_change(close, {w})", "-pct_change(close, 20)"),
    ("ts_min(low, {w}) / close - 1", "ret_1d"),
    ("close / ts_max(high, {w})", "volume / ts_mean(volume, {w})"),
    ("delta(volume, 5)", "-delta(close, 5)"),
    ("ret_20d", "-ts_std(ret_1d, 20)"),
    ("-ret_20d", "-ts_std(ret_1d, 20)"),
]
# (inner expressions, windows or window pairs)
FAMILIES = [
    (["-ts_corr(close, volume, {w})"], [3, 5, 10, 20, 40, 60]),
    (["ts_corr(close, volume, {w})"], [3, 5, 10, 20, 40, 60]),
    (["-ts_std(ret_1d, {a}) / (ts_std(ret_1d, {b}) + 0.001)"],
     [(5, 20), (5, 60), (10, 20), (10, 60), (20, 60)]),
    (["ts_std(ret_1d, {a}) / (ts_std(ret_1d, {b}) + 0.001)"],
     [(5, 20), (5, 60), (10, 20), (10, 60), (20, 60)]),
    (["(close - ts_min(low, {w})) / (ts_max(high, {w}) - ts_min(low, {w}) + 0.01)"],
     [5, 10, 20, 40, 60]),
    (["-((close - ts_min(low, {w})) / (ts_max(high, {w}) - ts_min(low, {w}) + 0.01))"],
     [5, 10, 20, 40, 60]),
    (["(close - low) / (high - low + 0.01)", "-pct_change(close, {w})"], [5, 10, 20]),
    (["(high - close) / (high - low + 0.01)", "pct_change(close, {w})"], [5, 10, 20]),
    (["ts_mean((close - open) / (high - low + 0.01), {w})"], WINDOWS),
    (["ts_mean((high - close) / (high - low + 0.01), {w})"], WINDOWS),
    (["ts_min(low, {a}) / ts_min(low, {b}) - 1"],
     [(5, 20), (5, 60), (10, 20), (10, 60)]),
    (["-(ts_max(high, {a}) / ts_max(high, {b}) - 1)"],
     [(5, 20), (5, 60), (10, 20), (10, 60)]),
    (["-(ts_max(high, {a}) - ts_min(low, {a})) / (ts_max(high, {b}) - ts_min(low, {b}) + 0.01)"],
     [(3, 20), (5, 20), (5, 60), (10, 60)]),
    (["pct_change(close, {w})"], [3, 10, 14, 30, 40]),
    (["-pct_change(close, {w})"], [3, 10, 14, 30, 40]),
    (["ret_5d - shift(ret_5d, {w})"], [5, 10, 20]),
    (["ts_mean(volume, {a}) / ts_mean(volume, {b})"],
     [(3, 10), (3, 20), (5, 20), (5, 60), (10, 60)]),
    (["ts_mean(high - low, {w}) / close"], [5, 10, 20]),
    (["ts_std(high - low, {w}) / ts_mean(high - low, {w})"], [5, 10, 20]),
    (["(close - ts_max(high, {w})) / ts_max(high, {w})"], [5, 10, 14, 30, 40, 60]),
    (["(close - ts_min(low, {w})) / ts_min(low, {w})"], [5, 10, 14, 30, 40, 60]),
    (["-ret_5d", "-volume / ts_mean(volume, {w})", "-ts_std(ret_1d, {w}) / (ts_std(ret_1d, 60) + 0.001)"],
     [10, 20]),
    (["ret_5d", "volume / ts_mean(volume, {w})", "close / ts_max(high, {w})"],
     [10, 20]),
]


def factor_grid() -> list[Candidate]:
    """All candidates, first of equal formulas kept."""
    out: dict[str, Candidate] = {}

    def add(inners, **at):
        made = Candidate(tuple(x.format(**at) for x in inners))
        out.setdefault(made.formula, made)

    for inner in SINGLES:
        for f in FEATURES:
            for w in WINDOWS if "{w}" in inner else [0]:
                add([inner], f=f, w=w)
    for pair in PAIRS:
        for w in WINDOWS:
            add(pair, w=w)
    for inners, windows in FAMILIES:
        for w in windows:
            add(inners, **({"a": w[0], "b": w[1]} if isinstance(w, tuple) else {"w": w}))
    return list(out.values())


def term_rows(panel: DataFrame, batch: list[tuple[int, Candidate]], keep: list[str], member: str | None = None) -> DataFrame:
    """(factor_id, x, symbol, date, keep...) of one batch; factor_id is the candidate's number.

    Distinct inner expressions become window columns once, however many
    candidates use them.
    """
    inners = sorted({x for _, cand in batch for x in cand.inners})
    at = {x: f"_x{i}" for i, x in enumerate(inners)}
    columns = panel.select(SYMBOL, DATE, *keep, *[masked(formula(x).cast("double"), member).alias(at[x]) for x in inners])
    rows = [
        F.struct(F.lit(i).alias(FACTOR), c(at[x]).alias("x"))
        for i, cand in batch
        for x in cand.inners
    ]
    return columns.select(SYMBOL, DATE, *keep, F.inline(F.array(*rows)))


def _batches(panel: DataFrame, grid: list[tuple[int, Candidate]], keep: list[str], size: int, member: str | None) -> DataFrame:
    """Batches keep generated code small; all of them read the same shuffled bars."""
    parts = [term_rows(panel, grid[i : i + size], keep, member) for i in range(0, len(grid), size)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def product_signals(
    panel: DataFrame, products: list[tuple[int, Candidate]], keep: list[str], width: int | None = None, batch: int = 60,
    member: str | None = None,
) -> DataFrame:
    """(factor_id, symbol, date, value, keep...) of products of ranks.

    Each distinct inner expression is ranked once, however many products have
    it as a term; the ranks of one bar then meet in one row, where all
    products are taken.
    """
    inners = sorted({x for _, cand in products for x in cand.inners})
    terms = _batches(panel, [(i, Candidate((x,))) for i, x in enumerate(inners)], keep, batch, member)
    ranked = ranking.order_stats(terms, [FACTOR, DATE], "x", "_x", width)
    rank = ranking.percent_rank("_x")
    cells = [F.max(F.when(c(FACTOR) == i, rank)).alias(f"_r{i}") for i in range(len(inners))]
    wide = ranked.groupBy(SYMBOL, DATE).agg(*cells, *[F.max(k).alias(k) for k in keep])
    at = {x: c(f"_r{i}") for i, x in enumerate(inners)}
    value = lambda cand: reduce(lambda a, b: a * b, [at[x] for x in cand.inners])
    rows = [F.struct(F.lit(i).alias(FACTOR), value(cand).alias(VALUE)) for i, cand in products]
    return wide.select(SYMBOL, DATE, *keep, F.inline(F.array(*rows)))


def grid_signals(
    panel: DataFrame, grid: list[Candidate], keep: list[str], width: int | None = None, batch: int = 60, member: str | None = None
) -> DataFrame:
    """(factor_id, symbol, date, value, keep...) of candidates on a numbered panel with features.

    A single rank orders names exactly as its inner expression does, so its
    value is left unranked; products multiply the percent ranks of their terms
    and are missing where any term is.  factor_id is the candidate's number in
    the grid (rows stay narrow); ``named`` turns it into names once rows are few.
    Number the panel with ``spread=True``. ``member`` names a flag (``panel.membership``): values outside the universe are missing.
    """
    out = [SYMBOL, DATE, FACTOR, VALUE, *keep]
    singles = [(i, x) for i, x in enumerate(grid) if len(x.inners) == 1]
    products = [(i, x) for i, x in enumerate(grid) if len(x.inners) > 1]
    parts = []
    if singles:
        parts.append(_batches(panel, singles, keep, batch, member).withColumnRenamed("x", VALUE).select(*out))
    if products:
        parts.append(product_signals(panel, products, keep, width, batch, member).select(*out))
    return reduce(lambda a, b: a.unionByName(b), parts)


def named(df: DataFrame, grid: list[Candidate]) -> DataFrame:
    names = F.array(*[F.lit(x.name) for x in grid])
    return df.withColumn(FACTOR, F.get(names, c(FACTOR)))


def mining_metrics(signals: DataFrame, target: str = "fwd_5", min_rows: int = 500, width: int | None = None) -> DataFrame:
    """ic, ic_ir, mono, q5_q1, score and direction per factor from one pass over its days."""
    return metrics_of_days(Q.daily_scores(Q.labelled(signals, target, width=width), target), min_rows)


def column_metrics(
    wide: DataFrame, factors: list[str], target: str = "fwd_5", min_rows: int = 500, width: int | None = None
) -> DataFrame:
    """``mining_metrics`` of factors that are columns of one row per (symbol, date)."""
    if not DS.fits(wide, width):
        return mining_metrics(long_signals(wide, factors, keep=[target]), target, min_rows, width)
    return metrics_of_days(DS.scores_of(wide, factors, target, width), min_rows)


def grid_metrics(
    panel: DataFrame, grid: list[Candidate], target: str = "fwd_5", min_rows: int = 500, width: int | None = None, member: str | None = None
) -> DataFrame:
    """``mining_metrics`` of ``grid_signals`` without their rows: each candidate a column, ranked on its date."""
    return metrics_of_days(grid_days(panel, grid, target, width, member), min_rows)


def grid_days(
    panel: DataFrame, grid: list[Candidate], target: str = "fwd_5", width: int | None = None, member: str | None = None
) -> DataFrame:
    """``quintiles.daily_scores`` of every candidate (factor_id is its number): one row per candidate and date."""
    if not DS.fits(panel, width):
        return Q.daily_scores(Q.labelled(grid_signals(panel, grid, [target], width, member=member), target, width=width), target)
    # Candidates over the same windows are neighbours, so that a batch evaluates each window once, whatever is made of it and with which sign.
    first = lambda x: next(iter(shared_calls([unsigned(x)[0]])[0].values()), "")
    order = sorted(range(len(grid)), key=lambda i: (first(grid[i].inners[0]), i))
    parts = []
    for batch in column_batches([grid[i] for i in order], DS.batch_size(width)):
        bare = {x: unsigned(x) for _, cand in batch for x in cand.inners}
        inners = sorted({text for text, _ in bare.values()})
        calls, plain = shared_calls(inners)
        made = panel.withColumns({name: formula(call) for name, call in calls.items()})
        columns = [masked(formula(plain[x]).cast("double"), member) for x in inners]
        place = {x: ~inners.index(text) if minus else inners.index(text) for x, (text, minus) in bare.items()}
        terms = [tuple(place[x] for x in cand.inners) for _, cand in batch]
        parts.append(DS.day_scores(made, columns, terms, target, [order[i] for i, _ in batch]))
    return reduce(lambda a, b: a.unionByName(b), parts)


def signal_columns(
    panel: DataFrame, chosen: list[Candidate], keep: list[str], width: int | None = None, member: str | None = None
) -> DataFrame:
    """``grid_signals`` as one row per (symbol, date) with a column per candidate, under its name; products of ranks come from rows."""
    if all(len(x.inners) == 1 for x in chosen):
        made = [masked(formula(x.inners[0]).cast("double"), member).alias(x.name) for x in chosen]
        return panel.select(SYMBOL, DATE, *keep, *made)
    signals = grid_signals(panel, chosen, keep, width, member=member)
    picked = [F.max(F.when(c(FACTOR) == i, c(VALUE))).alias(x.name) for i, x in enumerate(chosen)]
    return signals.groupBy(SYMBOL, DATE).agg(*[F.max(k).alias(k) for k in keep], *picked)


def column_batches(grid: list[Candidate], size: int) -> list[list[tuple[int, Candidate]]]:
    """The numbered grid in batches of at most ``size`` distinct inner expressions (more only for a candidate that has more)."""
    batches: list[list] = []
    held: set[str] = set()
    for i, cand in enumerate(grid):
        if not batches or len(held | set(cand.inners)) > size:
            batches.append([])
            held = set()
        batches[-1].append((i, cand))
        held |= set(cand.inners)
    return batches


def metrics_of_days(days: DataFrame, min_rows: int = 500) -> DataFrame:
    """ic, ic_ir, mono, q5_q1, score and direction per factor from ``daily_scores`` rows."""
    qs = [f"q{k}" for k in range(1, Q.GROUPS + 1)]
    agg = days.groupBy(FACTOR).agg(
        F.sum("n_stocks").alias("rows"),
        F.round(F.avg("ic"), 4).alias("ic"),
        F.avg("ic").alias("_m"),
        F.stddev_samp("ic").alias("_s"),
        *[F.coalesce(F.avg(q), F.lit(0.0)).alias(q) for q in qs],
    ).where(c("rows") >= min_rows)
    zero = F.lit(0.0)
    out = agg.select(
        FACTOR,
        "rows",
        F.coalesce("ic", zero).alias("ic"),
        F.coalesce(F.round(IC.information_ratio(c("_m"), c("_s")), 3), zero).alias("ic_ir"),
        F.round(Q.monotonicity([c(q) for q in qs]), 3).alias("mono"),
        F.round((c(qs[-1]) - c(qs[0])) * 100, 3).alias("q5_q1"),
    )
    return out.withColumns(
        {
            "score": G.mining_score(c("ic"), c("ic_ir"), c("mono")),
            "direction": F.when(c("ic") < 0, "short").otherwise("long"),
        }
    )


def candidate_table(spark, grid: list[Candidate], market: str) -> DataFrame:
    """The grid's names, formulas and stable ids as a (small) table."""
    from ..functions.scalar import stable_factor_id

    rows = [(x.name, x.formula, x.hypothesis) for x in grid]
    df = spark.createDataFrame(rows, "name string, formula string, hypothesis string")
    return df.withColumn("stable_id", stable_factor_id(F.lit(market), c("formula")))


def mine(
    panel: DataFrame, grid: list[Candidate], market: str, target: str = "fwd_5", resamples: int = 100_000,
    keep_at_most: int = 30, width: int | None = None, member: str | None = None,
) -> DataFrame:
    """Grid → scores → blacklist and gates → bootstrap → greedy de-duplication.

    Between the stages only factor names come back to decide what the next,
    much smaller job computes. The daily scores of the grid are stored, a row
    per candidate and date: gates and bootstrap both read them, and values are
    made again only for the candidates that de-duplication compares.
    """
    spark = panel.sparkSession
    days = cut(grid_days(panel, grid, target, width, member))
    scored = named(metrics_of_days(days), grid)
    names = candidate_table(spark, grid, market)
    scored = scored.join(F.broadcast(names.withColumnRenamed("name", FACTOR)), FACTOR)
    passed = scored.where(~G.blacklisted(c("formula")) & G.mining_gates(market)["all"])
    rows = passed.collect()  # one row per passing candidate
    schema = passed.schema
    if not rows:
        return spark.createDataFrame([], schema)
    passed = spark.createDataFrame(rows, schema)
    number = {x.name: i for i, x in enumerate(grid)}
    short = days.where(c(FACTOR).isin([number[r[FACTOR]] for r in rows]))
    daily = named(DS.ic_of(short, undefined="zero"), grid)
    tested = BS.bootstrap_significance(daily, resamples).where("significant_01").select(FACTOR, "p_value")
    sure = cut(passed.join(tested, FACTOR))
    left = [grid[number[r[0]]] for r in sure.select(FACTOR).collect()]
    if len(left) < 2:
        return sure
    wide = cut(signal_columns(panel, left, [target], width, member).where(c(target).isNotNull()).drop(target))
    return CR.greedy_distinct(wide, sure, 0.6, keep_at_most, min_rows=100, width=width)
