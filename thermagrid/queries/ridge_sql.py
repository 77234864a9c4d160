"""SQL of weighted ridge fits by normal equations, for the twins of the model queries.

The route is another than the library's: rows are filled, standardised and centred
one by one, folds are left out by a join, and the normal equations are eliminated
in a recursive query.
"""

from __future__ import annotations

from collections.abc import Sequence

NOISE = "1e-9"


def _flat(i: int | str, alias: str = "") -> str:
    """Condition: input ``i`` varies by more than rounding."""
    return f"{alias}sz_{i} > {NOISE} * greatest(1.0, abs({alias}mz_{i}))"


def ridge_ctes(name: str, source: str, features: Sequence[str], label: str, alpha: float, keys: Sequence[str] = ("u",),
               fold: bool = False, balance: str | None = None) -> str:
    """Common table expressions that end in ``name``: one row of parameters for each key (and
    left-out fold). ``source`` has the keys (a constant ``u`` without any), the features, the
    label, ``fold`` and the day size ``balance`` where they are used."""
    group = [*keys, *(["fold"] if fold else [])]
    by, using = ", ".join(group), f"USING ({', '.join(group)})"
    n, both = len(features), 2 * len(features)
    rng = range(both)
    if fold:
        same = " AND ".join(f"f.{k} = s.{k}" for k in keys)
        rows = (f"SELECT s.* EXCLUDE (fold), f.fold FROM {source} s JOIN (SELECT DISTINCT {by} FROM {source}) f ON {same} AND f.fold <> s.fold "
                f"WHERE s.{label} IS NOT NULL")
    else:
        rows = f"SELECT * FROM {source} WHERE {label} IS NOT NULL"
    z = [f"coalesce({f}, md_{i}, 0.0)::DOUBLE AS z_{i}" for i, f in enumerate(features)]
    z += [f"({f} IS NULL)::INT::DOUBLE AS z_{i + n}" for i, f in enumerate(features)]
    weight = f"avg({balance}) OVER (PARTITION BY {by}) / {balance}" if balance else "1.0::DOUBLE"
    gram = ", ".join("[" + ", ".join([f"sum(w * (v_{i} - c_{i}) * (v_{j} - c_{j})){f' + {alpha!r}' if i == j else ''}" for j in rng]
                                     + [f"sum(w * (v_{i} - c_{i}) * (y - y0))"]) + "]" for i in rng)
    return f"""
{name}_t AS ({rows}),
{name}_d AS (SELECT {by}, {", ".join(f"median({f}) AS md_{i}" for i, f in enumerate(features))} FROM {name}_t GROUP BY {by}),
{name}_z AS (SELECT {by}, {", ".join(z)}, {label}::DOUBLE AS y, {weight} AS w FROM {name}_t JOIN {name}_d {using}),
{name}_s AS (SELECT {by}, {", ".join(f"avg(z_{i}) AS mz_{i}, stddev_pop(z_{i}) AS sz_{i}" for i in rng)} FROM {name}_z GROUP BY {by}),
{name}_n AS (SELECT {by}, y, w, {", ".join(f"CASE WHEN {_flat(i)} THEN (z_{i} - mz_{i}) / sz_{i} ELSE 0.0 END AS v_{i}" for i in rng)}
  FROM {name}_z JOIN {name}_s {using}),
{name}_c AS (SELECT {by}, sum(w * y) / sum(w) AS y0, {", ".join(f"sum(w * v_{i}) / sum(w) AS c_{i}" for i in rng)} FROM {name}_n GROUP BY {by}),
{name}_e AS (SELECT {by}, 1 AS k, [{gram}] AS m FROM {name}_n JOIN {name}_c {using} GROUP BY {by}
  UNION ALL SELECT {by}, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / r[k])
    ELSE list_transform(r, lambda v, j: v - r[k] / m[k][k] * m[k][j]) END) FROM {name}_e WHERE k <= {both}),
{name} AS (SELECT * EXCLUDE (k, m), {", ".join(f"m[{i + 1}][{both + 1}] AS b_{i}" for i in rng)}
  FROM {name}_e JOIN {name}_c {using} JOIN {name}_s {using} JOIN {name}_d {using} WHERE k = {both + 1})"""


def ridge_value(row: str, model: str, features: Sequence[str]) -> str:
    """Prediction for the row alias ``row`` by the parameters under the alias ``model``."""
    n, q = len(features), f"{model}."
    parts = [f"{q}y0"]
    for i, f in enumerate(features):
        for k, value in ((i, f"coalesce({row}.{f}, {q}md_{i}, 0.0)"), (i + n, f"({row}.{f} IS NULL)::INT")):
            parts.append(f"{q}b_{k} * (CASE WHEN {_flat(k, q)} THEN ({value} - {q}mz_{k}) / {q}sz_{k} ELSE 0.0 END - {q}c_{k})")
    return "(" + " + ".join(parts) + ")"
