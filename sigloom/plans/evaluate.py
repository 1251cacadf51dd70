"""Evaluating factors: one definition on a panel, or one factor end to end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..columns import BAR, DATE, FACTOR, SYMBOL, VALUE
from ..functions import cross as C
from ..functions.formula import PerDate, formula, split
from ..operators import dayscores as DS, ic as IC, panel as P, ranking, walkforward as WF


def masked(x: Column, member: str | None) -> Column:
    """Missing outside the universe that the flag column ``member`` marks."""
    return x if member is None else F.when(F.col(member), x)


def per_date(df: DataFrame, nodes: list[PerDate], member: str | None = None) -> DataFrame:
    """Add the columns of one stage's nodes; no task holds a whole date. Names outside the universe are missing from every cross-section."""
    inputs = {x: f"_in{i}" for i, x in enumerate(dict.fromkeys(n.inputs[0] for n in nodes))}
    groups = {x: f"_by{i}" for i, x in enumerate(dict.fromkeys(x for n in nodes for x in n.inputs[1:]))}
    out = df.withColumns({at: masked(formula(x), member) for x, at in inputs.items()} | {at: formula(x) for x, at in groups.items()})
    of = lambda name: {n.name: inputs[n.inputs[0]] for n in nodes if n.operator == name}
    out = C.with_places(out, of("rank"), {n.name: (inputs[n.inputs[0]], n.number or 5) for n in nodes if n.operator == "quantile"})
    if of("zscore"):
        out = C.with_zscores(out, of("zscore"))
    if of("demean"):
        out = C.with_demeaned(out, of("demean"))
    for n in nodes:
        if n.operator == "neutralize":
            out = C.with_neutralized(out, inputs[n.inputs[0]], groups[n.inputs[1]], n.name)
    return out.select(*df.columns, *[n.name for n in nodes])


def compute_factors(
    df: DataFrame, formulas: dict[str, str], keep: tuple[str, ...] = (), member: str | None = None, width: int | None = None
) -> DataFrame:
    """(symbol, date, bar_no, keep...) and one column per named formula, on a numbered panel with features.

    The formulas are cut at their per-date operators (``formula.split``); each
    stage adds its nodes once for all formulas. Formulas without such nodes
    are one select, so that their windows share their sorts. ``member`` names
    a flag (``panel.membership``): rolling operators see all of a symbol's
    bars, cross-sections and results only those inside the universe. Where all
    formulas are plain ranks and ``width`` says that a date fits a task, its
    names are ranked there, all formulas at once.
    """
    stages, rest = split(formulas)
    plain = {n.name: n.inputs[0] for nodes in stages for n in nodes if n.operator == "rank"}
    if width is not None and len(stages) == 1 and all(t in plain for t in rest.values()) and DS.fits(df, width):
        inner = {n: masked(formula(plain[t]), member).alias(n) for n, t in rest.items()}
        return DS.percent_ranks(df.select(SYMBOL, DATE, BAR, *keep, *inner.values()), list(inner), width)
    for nodes in stages:
        df = per_date(df, nodes, member)
    return df.select(SYMBOL, DATE, BAR, *keep, *[masked(formula(t), member).alias(n) for n, t in rest.items()])


def universe_ranks(df: DataFrame, inner: dict[str, str], n: int, cap: str = "market_cap") -> DataFrame:
    """(symbol, date) and the percent ranks of ``inner`` among the ``n`` largest names of each date, on a numbered panel.

    As ``compute_factors`` with a membership flag: values see all of a symbol's bars. But a date's members are found among the
    values themselves, before any other row leaves its task, so bars are not joined with their membership.
    """
    values = df.select(SYMBOL, DATE, cap, *[formula(x).alias(f"_in_{name}") for name, x in inner.items()])
    ranked = P.universe(values, n, cap)
    for name in inner:
        ranked = ranking.order_stats(ranked, [DATE], f"_in_{name}", f"_{name}", width=n)
    return ranked.select(SYMBOL, DATE, *[ranking.percent_rank(f"_{name}").alias(name) for name in inner])


def compute_factor(df: DataFrame, text: str) -> DataFrame:
    """[symbol, date, factor_value] of one formula on a numbered panel with features."""
    return compute_factors(df, {"factor_value": text}).drop(BAR)


def evaluate_formula(
    bars: DataFrame, text: str, oos_start: str, horizon: int = 5, cost: float = 0.003, direction: str = "long",
    width: int | None = None, universe: int | None = None, cap: str = "market_cap",
) -> dict[str, DataFrame]:
    """Walk-forward folds, their averages and the IC series of one formula on raw bars; ``universe`` keeps the largest names of each date."""
    bars, member = P.positive_close(bars), None
    if universe is not None:
        bars, member = P.membership(bars, universe, cap), P.MEMBER
    panel = P.with_features(P.index_bars(bars))
    target = f"fwd_{horizon}"
    values = compute_factors(panel.withColumn(target, P.forward_return(horizon)), {VALUE: text}, keep=(target,), member=member)
    value = F.col(VALUE)
    long = values.select(F.lit("formula").alias(FACTOR), SYMBOL, DATE, (-value if direction == "short" else value).alias(VALUE), target)
    folds = WF.fold_dates(P.trade_dates(panel), oos_start)
    metrics = WF.fold_metrics(long, folds, target, cost, horizon, width=width)
    return {
        "folds": metrics,
        "summary": WF.walk_forward(metrics),
        "ic": IC.daily_ic(long, target, width=width),
    }
