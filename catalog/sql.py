"""SQL for the derived inputs, chained as CTEs.  ``with_(names, body)`` puts a query together."""

from __future__ import annotations

PARTS: dict[str, tuple[list[str], str]] = {}


def part(name: str, needs: list[str], body: str) -> None:
    PARTS[name] = (needs, body)


def with_(names, body: str) -> str:
    done: list[str] = []

    def visit(n):
        if n in done:
            return
        for m in PARTS[n][0]:
            visit(m)
        done.append(n)

    for n in names.split() if isinstance(names, str) else names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in done) + "\n" + body


def day(col: str, name: str | None = None) -> str:
    return f"strftime({col}, '%Y-%m-%d') AS {name or col.split('.')[-1]}"


def corr(a: str, b: str, extra: str = "") -> str:
    """Pearson with NULL for constant input."""
    e = f"corr({a}, {b}){extra}"
    return f"CASE WHEN isnan({e}) THEN NULL ELSE {e} END"


def avg_rank(x: str, keys: str) -> str:
    return (
        f"(rank() OVER (PARTITION BY {keys} ORDER BY {x} NULLS LAST)"
        f" + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0)"
    )


def qlabel(x: str, keys: str, valid: str = "TRUE") -> str:
    """Quintile by interpolated edges (right-closed) over the rows of the group."""
    q = f"(quantile_cont({x}, [0.2, 0.4, 0.6, 0.8]) FILTER (WHERE {valid}) OVER (PARTITION BY {keys}))"
    return "(1 + " + " + ".join(f"CAST({x} > {q}[{k}] AS INT)" for k in (1, 2, 3, 4)) + ")"


part(
    "trades",
    [],
    """SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
       l_extendedprice / l_quantity AS price, * FROM lineitem""",
)
_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice"
part(
    "bars",
    ["trades"],
    f"""SELECT symbol, date, first(price ORDER BY {_ORDER}) AS open, max(price) AS high, min(price) AS low,
       last(price ORDER BY {_ORDER}) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) AS amount
       FROM trades GROUP BY symbol, date""",
)
part(
    "panel",
    ["bars"],
    """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS bar_no FROM bars WHERE close > 0""",
)
part(
    "featured",
    ["panel"],
    """SELECT *, close / lag(close, 1) OVER w - 1 AS ret_1d, close / lag(close, 5) OVER w - 1 AS ret_5d,
       close / lag(close, 20) OVER w - 1 AS ret_20d,
       volume / avg(volume) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS volume_ratio,
       amount / volume AS vwap
       FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY bar_no)""",
)
part(
    "means",
    ["featured"],
    """SELECT *, CASE WHEN bar_no >= 5 THEN avg(close) OVER (w ROWS 4 PRECEDING) END AS m5,
       CASE WHEN bar_no >= 10 THEN avg((high - low) / close) OVER (w ROWS 9 PRECEDING) END AS x_range,
       CASE WHEN bar_no >= 20 THEN volume / avg(volume) OVER (w ROWS 19 PRECEDING) END AS x_surge,
       CASE WHEN count(ret_1d) OVER (w ROWS 19 PRECEDING) = 20
            THEN -stddev_samp(ret_1d) OVER (w ROWS 19 PRECEDING) END AS x_vol,
       CASE WHEN bar_no >= 20 THEN -corr(close, volume) OVER (w ROWS 19 PRECEDING) END AS x_vpdiv,
       lead(close, 1) OVER w / close - 1 AS fwd_1, lead(close, 5) OVER w / close - 1 AS fwd_5,
       lead(close, 7) OVER w / close - 1 AS fwd_7, lead(close, 14) OVER w / close - 1 AS fwd_14,
       lead(close, 30) OVER w / close - 1 AS fwd_30
       FROM featured WINDOW w AS (PARTITION BY symbol ORDER BY bar_no)""",
)
part(
    "wide",
    ["means"],
    """SELECT *, m5 - lag(m5, 10) OVER (PARTITION BY symbol ORDER BY bar_no) AS mom, x_range AS range, -ret_5d AS rev,
       x_surge AS surge, x_vol AS vol, CASE WHEN isnan(x_vpdiv) THEN NULL ELSE x_vpdiv END AS vpdiv FROM means""",
)
_LONG = " UNION ALL ".join(
    f"SELECT '{f}' AS factor_id, symbol, date, bar_no, close, {f} AS x, fwd_1, fwd_5, fwd_7, fwd_14, fwd_30 FROM wide"
    for f in ["mom", "range", "rev", "surge", "vol", "vpdiv"]
)
part("long_inputs", ["wide"], _LONG)
part(
    "signals",
    ["long_inputs"],
    f"""SELECT *, CASE WHEN x IS NOT NULL THEN {avg_rank('x', 'factor_id, date')}
        / count(x) OVER (PARTITION BY factor_id, date) END AS value FROM long_inputs""",
)


def inverse_parts(name: str, source: str, columns: list[str], by: str | None = None) -> str:
    """Parts that invert the correlation matrix of ``columns`` (of each ``by``); the last has (by, i, j, v). Its name comes back.

    A constant column counts as uncorrelated.
    """
    k = len(columns)
    own = f"{by}, " if by else ""
    same = "".join(f" AND {x}.{by} = a.{by}" for x in "x") if by else ""
    cell = lambda i, j, a, b: "1.0" if i == j else f"coalesce({corr(a, b)}, 0)"
    cells = ", ".join(f"{{'i': {i}, 'j': {j}, 'v': {cell(i, j, a, b)}}}" for i, a in enumerate(columns) for j, b in enumerate(columns))
    group = f" GROUP BY {by}" if by else ""
    part(f"{name}_inv0", [source], f"SELECT {own}x.i AS i, x.j AS j, x.v AS v FROM (SELECT {own}unnest([{cells}]) AS x FROM {source}{group})")
    for p in range(k):
        was, now = f"{name}_inv{p}", f"{name}_inv{p + 1}"
        on = lambda t: same.replace("x.", f"{t}.")
        part(
            now,
            [was],
            f"""SELECT {"a." + own if by else ""}a.i, a.j, CASE WHEN a.i = {p} AND a.j = {p} THEN 1 / d.v WHEN a.i = {p} THEN a.v / d.v WHEN a.j = {p} THEN -a.v / d.v
                ELSE a.v - r.v * s.v / d.v END AS v FROM {was} a JOIN {was} d ON d.i = {p} AND d.j = {p}{on("d")} JOIN {was} r ON r.i = a.i AND r.j = {p}{on("r")}
                JOIN {was} s ON s.i = {p} AND s.j = a.j{on("s")}""",
        )
    return f"{name}_inv{k}"


def eigen_cte(name: str, source: str, columns: list[str], sweeps: int = 8) -> str:
    """Recursive CTEs for the eigenvalues (one list ``eig``) of the correlation matrix of ``columns``, by cyclic rotations."""
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    cells = ", ".join("1.0::DOUBLE" if a == b else f"corr({a}, {b})" for a in columns for b in columns)
    at = lambda m, i, j: f"{m}[({i}) * {k} + ({j}) + 1]"
    turn = lambda m, first, second, i, j, on: (
        f"CASE WHEN {on} = p THEN c * {at(m, *first)} - s * {at(m, *second)} WHEN {on} = q THEN s * {at(m, *first)} + c * {at(m, *second)} ELSE {at(m, i, j)} END"
    )
    i, j = f"(x // {k})", f"(x % {k})"
    return f"""{name}_rot AS (
  SELECT 0 AS step, [{cells}] AS a FROM {source}
  UNION ALL
  SELECT step + 1, list_transform(range({k * k}), lambda x: {turn('b', ('p', j), ('q', j), i, j, i)}) FROM (
    SELECT *, list_transform(range({k * k}), lambda x: {turn('a', (i, 'p'), (i, 'q'), i, j, j)}) AS b FROM (
      SELECT *, 1 / sqrt(1 + t * t) AS c, t / sqrt(1 + t * t) AS s FROM (
        SELECT *, CASE WHEN abs({at('a', 'p', 'q')}) < 1e-300 THEN 0 ELSE (CASE WHEN tau < 0 THEN -1 ELSE 1 END) / (abs(tau) + sqrt(1 + tau * tau)) END AS t FROM (
          SELECT *, ({at('a', 'q', 'q')} - {at('a', 'p', 'p')}) / (2 * nullif({at('a', 'p', 'q')}, 0)) AS tau FROM (
            SELECT step, a, {[x for x, _ in pairs]}[step % {len(pairs)} + 1] AS p, {[x for _, x in pairs]}[step % {len(pairs)} + 1] AS q
            FROM {name}_rot WHERE step < {sweeps * len(pairs)})))))),
{name} AS (SELECT list_transform(range({k}), lambda x: a[x * {k} + x + 1]) AS eig FROM {name}_rot WHERE step = {sweeps * len(pairs)})"""
