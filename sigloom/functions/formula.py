"""Factor formulas as text.

A formula such as ``rank(delta(ts_mean(close, 5), 10))`` is a Python expression
over the builders of this package, so Python itself evaluates it: names become
columns, calls become window expressions, arithmetic becomes Column arithmetic.

``rank``, ``zscore``, ``demean``, ``quantile`` and ``neutralize`` look across a
date. ``split`` cuts a formula at them: what they are taken of, they themselves
and what is made of them are stages, and between the stages only Columns of one
symbol's rows are left.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from . import rolling, scalar

ROLLING = (
    "ts_mean ts_std ts_max ts_min ts_sum ts_rank ts_argmax ts_argmin ts_corr ts_cov ts_count ts_skew ts_kurt "
    "ts_product delta pct_change shift decay_linear decay_exp"
).split()

BUILDERS = {
    **{n: getattr(rolling, n) for n in ROLLING},
    "abs": scalar.absolute,
    "sign": scalar.sign,
    "log": scalar.log,
    "sqrt": scalar.sqrt,
    "power": scalar.power,
    "clamp": scalar.clamp,
    "max": scalar.larger,
    "min": scalar.smaller,
    "if_then": scalar.if_then,
}

#: Operators over one date, with the number of columns each is taken of; further arguments are numbers.
PER_DATE = {"rank": 1, "zscore": 1, "demean": 1, "quantile": 1, "neutralize": 2}

_ALLOWED = (
    ast.Expression, ast.BinOp, ast.UnaryOp, ast.Call, ast.Name, ast.Load, ast.Constant,
    ast.Add, ast.Sub, ast.Mult, ast.Div, ast.USub,
)


class _Divide(ast.NodeTransformer):
    """a / b → ratio(a, b): a zero denominator gives missing, not an error."""

    def visit_BinOp(self, node):
        self.generic_visit(node)
        if isinstance(node.op, ast.Div):
            return ast.Call(ast.Name("ratio", ast.Load()), [node.left, node.right], [])
        return node


def _checked(text: str) -> ast.Expression:
    tree = ast.parse(text.strip(), mode="eval")
    for node in ast.walk(tree):
        if not isinstance(node, _ALLOWED):
            raise ValueError(f"not part of a formula: {type(node).__name__} in {text!r}")
        if isinstance(node, ast.Call) and not (isinstance(node.func, ast.Name) and node.func.id in BUILDERS | PER_DATE):
            raise ValueError(f"unknown operator in {text!r}")
    return tree


def formula(text: str, extra: dict | None = None) -> Column:
    """The Column a formula without per-date operators stands for."""
    tree = _checked(text)
    calls = {n.func.id for n in ast.walk(tree) if isinstance(n, ast.Call)}
    if calls & set(PER_DATE):
        raise ValueError(f"looks across a date, so it is no Column of one symbol's rows: {text!r}")
    names = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} - calls
    tree = ast.fix_missing_locations(_Divide().visit(tree))
    scope = {n: F.col(n) for n in names} | {n: BUILDERS[n] for n in calls} | {"ratio": scalar.ratio} | (extra or {})
    value = eval(compile(tree, "<formula>", "eval"), {"__builtins__": {}}, scope)  # noqa: S307 - nodes checked above
    return value if isinstance(value, Column) else F.lit(float(value))


def unsigned(text: str) -> tuple[str, bool]:
    """A formula without the minus in front of all of it, and whether there was one; the sign of a double is exact."""

    def strip(node: ast.expr) -> tuple[ast.expr, bool]:
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            inner, minus = strip(node.operand)
            return inner, not minus
        if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Mult, ast.Div)):
            left, minus = strip(node.left)
            return ast.BinOp(left, node.op, node.right), minus
        return node, False

    node, minus = strip(_checked(text).body)
    return ast.unparse(ast.fix_missing_locations(node)), minus


def shared_calls(texts: list[str]) -> tuple[dict[str, str], dict[str, str]]:
    """Column → rolling call of all outermost rolling calls, equal ones once, and each formula in terms of these columns.

    Spark evaluates a window expression as often as it is written.
    """
    made: dict[str, str] = {}

    class Share(ast.NodeTransformer):
        def visit_Call(self, node):
            if node.func.id not in ROLLING:
                return self.generic_visit(node)
            return ast.Name(made.setdefault(ast.unparse(node), f"_w{len(made)}"), ast.Load())

    plain = {text: ast.unparse(ast.fix_missing_locations(Share().visit(_checked(text)))) for text in texts}
    return {name: call for call, name in made.items()}, plain


@dataclass(frozen=True)
class PerDate:
    """One per-date node: its operator, the texts it is taken of, its number, and the column that it becomes."""

    name: str
    operator: str
    inputs: tuple[str, ...]
    number: int | None


def split(formulas: dict[str, str]) -> tuple[list[list[PerDate]], dict[str, str]]:
    """Stages of per-date nodes, and each formula in terms of the columns they become.

    A node is in the stage after the last node inside it. Equal nodes are one,
    within a formula and between formulas.
    """
    stages: list[list[PerDate]] = []
    made: dict[tuple, tuple[str, int]] = {}

    class Cut(ast.NodeTransformer):
        depth = 0

        def visit_Call(self, node):
            if node.func.id not in PER_DATE:
                return self.generic_visit(node)
            outer, self.depth = self.depth, 0
            node = self.generic_visit(node)
            k = PER_DATE[node.func.id]
            number = ast.literal_eval(node.args[k]) if len(node.args) > k else None
            key = (node.func.id, tuple(ast.unparse(x) for x in node.args[:k]), number)
            if key not in made:
                if len(stages) == self.depth:
                    stages.append([])
                name = f"_d{len(made)}"
                stages[self.depth].append(PerDate(name, *key))
                made[key] = name, self.depth + 1
            name, level = made[key]
            self.depth = max(outer, level)
            return ast.Name(name, ast.Load())

    out = {}
    for name, text in formulas.items():
        cutter = Cut()
        out[name] = ast.unparse(ast.fix_missing_locations(cutter.visit(_checked(text))))
    return stages, out


#: Bars before the current one that a feature of the panel looks at.
FEATURE_BARS = {"ret_1d": 1, "ret_5d": 5, "ret_20d": 20, "volume_ratio": 19}
#: Operators that look n bars back; the other rolling ones look at n bars including the current one.
SHIFTS = {"delta", "pct_change", "shift"}
#: Operators whose value depends on all bars so far.
ENDLESS = {"decay_exp"}


def look_back(text: str) -> int | None:
    """How many bars before the current one a formula's value depends on; None where on all of them."""

    def of(node: ast.AST) -> int | None:
        if isinstance(node, ast.Name):
            return FEATURE_BARS.get(node.id, 0)
        name = node.func.id if isinstance(node, ast.Call) else ""
        if name in ENDLESS:
            return None
        windowed = name in SHIFTS or name.startswith(("ts_", "decay_"))
        parts = node.args[:-1] if windowed else node.args if name else list(ast.iter_child_nodes(node))
        inner = [of(x) for x in parts]
        if None in inner:
            return None
        own = ast.literal_eval(node.args[-1]) - (name not in SHIFTS) if windowed else 0
        return max(inner, default=0) + own

    return of(_checked(text).body)
