"""Matrices as SQL lists, for oracles: correlations, inverses, eliminations, Newton steps of logistic regressions."""

from __future__ import annotations

from collections.abc import Sequence


def correlations(columns: Sequence[str]) -> str:
    """Nested list of correlations, an aggregate over a group."""
    cell = lambda i, j: "1.0::DOUBLE" if i == j else f"coalesce(corr({columns[min(i, j)]}, {columns[max(i, j)]}), 0)"
    n = range(len(columns))
    return "[" + ", ".join("[" + ", ".join(cell(i, j) for j in n) + "]" for i in n) + "]"


def inverse(tag: str, src: str, columns: Sequence[str], keys: str = "") -> str:
    """Expression ``tag`` (keys, a): the inverse correlation matrix of each group, one column swept after the other."""
    k, by, p = (f"{keys}, ", f" GROUP BY {keys}", len(columns)) if keys else ("", "", len(columns))
    return f"""{tag}0 AS MATERIALIZED (SELECT {k}{correlations(columns)} AS a FROM {src}{by}),
      {tag}s AS (SELECT 0 AS k, {k}a FROM {tag}0 UNION ALL
        SELECT k + 1, {k}[[CASE WHEN i = k + 1 AND j = k + 1 THEN -1 / a[i][j] WHEN i = k + 1 OR j = k + 1 THEN a[i][j] / a[k + 1][k + 1]
          ELSE a[i][j] - a[i][k + 1] * a[k + 1][j] / a[k + 1][k + 1] END FOR j IN range(1, {p + 1})] FOR i IN range(1, {p + 1})] FROM {tag}s WHERE k < {p}),
      {tag} AS MATERIALIZED (SELECT {k}[[-x FOR x IN r] FOR r IN a] AS a FROM {tag}s WHERE k = {p})"""


def elimination(tag: str, inverses: str, columns: Sequence[str], threshold: float, keys: str = "") -> str:
    """Expression ``tag`` (keys, step, removed, vif) from (keys, bs), lists of inverse matrices: the largest mean VIF goes while above the threshold."""
    k = f"{keys}, " if keys else ""
    names = "[" + ", ".join(f"'{c}'" for c in columns) + "]"
    return f"""{tag}e AS (SELECT 0 AS step, {k}{names} AS names, bs, NULL::VARCHAR AS removed, NULL::DOUBLE AS vif FROM {inverses} UNION ALL
        SELECT step + 1, {k}[names[i] FOR i IN range(1, len(names) + 1) IF i <> w],
          [[[b[i][j] - b[i][w] * b[w][j] / b[w][w] FOR j IN range(1, len(names) + 1) IF j <> w] FOR i IN range(1, len(names) + 1) IF i <> w] FOR b IN bs],
          names[w], d[w] FROM (SELECT *, list_position(d, list_max(d)) AS w FROM (
            SELECT *, [list_avg([b[i][i] FOR b IN bs]) FOR i IN range(1, len(names) + 1)] AS d FROM {tag}e))
        WHERE len(names) > 1 AND d[w] > {threshold}),
      {tag} AS (SELECT {k}CAST(step AS INTEGER) AS step, removed, vif FROM {tag}e WHERE step > 0)"""


def newton(tag: str, src: str, keys: str, d: int, steps: int = 14) -> str:
    """Expression ``tag`` (keys, b): logistic coefficients of each group of ``src`` (keys, y, x, penalty).

    ``x`` is a list of ``d`` numbers, the first 1; ``penalty`` is a list of as many weights
    of the squared coefficients, summed over rows.  Each step solves its system by elimination.
    """
    index = range(1, d + 1)
    out = [f"{tag}0 AS (SELECT {keys}, [0.0::DOUBLE FOR i IN range({d})] AS b FROM {src} GROUP BY {keys} HAVING sum(y) > 0 AND sum(y) < count(*))"]
    rows = ", ".join("[" + ", ".join([*[f"sum(w * x[{min(i, j)}] * x[{max(i, j)}]){f' + any_value(penalty[{i}])' if i == j else ''}" for j in index], f"sum((y - m) * x[{i}]) - any_value(penalty[{i}] * b[{i}])"]) + "]" for i in index)
    for t in range(1, steps + 1):
        now = f"""SELECT {keys}, b, [{rows}] AS a FROM (SELECT *, m * (1 - m) AS w FROM (
          SELECT *, 1 / (1 + exp(-list_dot_product(b, x))) AS m FROM {src} JOIN {tag}{t - 1} USING ({keys}))) GROUP BY {keys}, b"""
        out.append(f"{tag}s{t}_0 AS MATERIALIZED ({now})")
        for k in index:
            out.append(
                f"""{tag}s{t}_{k} AS MATERIALIZED (SELECT {keys}, b, [[CASE WHEN i = {k} THEN a[{k}][j] / a[{k}][{k}] ELSE a[i][j] - a[i][{k}] * a[{k}][j] / a[{k}][{k}] END
                FOR j IN range(1, {d + 2})] FOR i IN range(1, {d + 1})] AS a FROM {tag}s{t}_{k - 1})"""
            )
        out.append(f"{tag}{t} AS MATERIALIZED (SELECT {keys}, [b[i] + a[i][{d + 1}] FOR i IN range(1, {d + 1})] AS b FROM {tag}s{t}_{d})")
    out.append(f"{tag} AS (SELECT * FROM {tag}{steps})")
    return ", ".join(out)
