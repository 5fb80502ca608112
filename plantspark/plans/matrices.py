"""Matrices and distances in SQL, for the oracle queries: numbers f0, f1, ... per unit and hour ``b``."""

from __future__ import annotations

#: How the five instruments of a unit are found, in the order of the matrix.
FIVE = ("%SI-%", "%FI-%", "%PIA%", "%TI-%", "%XI-%")


def matrix_cte(name: str = "mx", filled: str = "hf") -> str:
    columns = ", ".join(f"max(value) FILTER (tag LIKE '{like}') AS f{i}" for i, like in enumerate(FIVE))
    return f"{name} AS (SELECT plant, unit, b, {columns} FROM {filled} GROUP BY plant, unit, b HAVING count(value) = {len(FIVE)})"


def based_cte(fraction: float, matrix: str = "mx", name: str = "bx") -> str:
    order = "row_number() OVER (PARTITION BY plant, unit ORDER BY b) <= floor(count(*) OVER (PARTITION BY plant, unit) * " + str(fraction) + ")"
    return f"{name} AS (SELECT *, {order} AS is_base FROM {matrix})"


def distance_ctes(rows: str, fit: str, end: str, k: int = len(FIVE)) -> str:
    """``md{end}``: ``rows`` with the Mahalanobis distance ``d`` from the mean and covariance of the rows of ``fit``, by Cholesky factors."""
    sums = [f"avg(f{i}) AS m{i}" for i in range(k)] + [f"covar_samp(f{i}, f{j}) AS c{i}{j}" for i in range(k) for j in range(i + 1)]
    factor = f"(SELECT plant, unit, {', '.join(sums)} FROM {fit} GROUP BY plant, unit)"
    for j in range(k):
        inner = " - ".join([f"c{j}{j}", *[f"l{j}{m} * l{j}{m}" for m in range(j)]])
        factor = f"(SELECT *, sqrt({inner}) AS l{j}{j} FROM {factor})"
        for i in range(j + 1, k):
            inner = " - ".join([f"c{i}{j}", *[f"l{i}{m} * l{j}{m}" for m in range(j)]])
            factor = f"(SELECT *, ({inner}) / l{j}{j} AS l{i}{j} FROM {factor})"
    solved = f"(SELECT r.*, g.* EXCLUDE (plant, unit) FROM {rows} r JOIN fac{end} g USING (plant, unit))"
    for i in range(k):
        inner = " - ".join([f"f{i} - m{i}", *[f"l{i}{m} * y{m}" for m in range(i)]])
        solved = f"(SELECT *, ({inner}) / l{i}{i} AS y{i} FROM {solved})"
    drop = ", ".join([f"m{i}" for i in range(k)] + [f"{x}{i}{j}" for x in "cl" for i in range(k) for j in range(i + 1)] + [f"y{i}" for i in range(k)])
    squares = " + ".join(f"y{i} * y{i}" for i in range(k))
    return f"fac{end} AS (SELECT * FROM {factor}), md{end} AS (SELECT * EXCLUDE ({drop}), sqrt({squares}) AS d FROM {solved})"


def rates_ctes(measured: str, quantile: float, end: str) -> str:
    """``rate{end}``: rows, test rows, anomalies and their rate per unit, above the baseline's own quantile."""
    return f"""th{end} AS (SELECT plant, unit, quantile_cont(d, {quantile}) AS t FROM {measured} WHERE is_base GROUP BY plant, unit),
    rate{end} AS (SELECT plant, unit, count(*) AS rows, count(*) FILTER (NOT is_base) AS test_rows, count(*) FILTER (NOT is_base AND d > t) AS anomalies, coalesce(count(*) FILTER (NOT is_base AND d > t) * 1.0 / nullif(count(*) FILTER (NOT is_base), 0), 0) AS anomaly_rate
      FROM {measured} JOIN th{end} USING (plant, unit) GROUP BY plant, unit)"""


def robust_ctes(based: str, support: float, steps: int) -> str:
    """``md_r``: ``based`` with distances after ``steps`` refits on the ``support`` share of the baseline closest to the centre."""
    out, fit = [f"only_base AS (SELECT * FROM {based} WHERE is_base)"], "only_base"
    for s in range(steps):
        out.append(distance_ctes("only_base", fit, f"_s{s}"))
        out.append(f"near_s{s} AS (SELECT r.* FROM md_s{s} r JOIN (SELECT plant, unit, quantile_cont(d, {support}) AS q FROM md_s{s} GROUP BY plant, unit) USING (plant, unit) WHERE d <= q)")
        fit = f"near_s{s}"
    return ", ".join([*out, distance_ctes(based, fit, "_r")])


def runs_ctes(hourly: str = "hm", matrix: str = "mx", end: str = "") -> str:
    """``mr{end}``: the matrix at the unit's hours with readings, with ``n`` hours until the next one."""
    return f"""nb{end} AS (SELECT *, coalesce(date_diff('hour', b, lead(b) OVER (PARTITION BY plant, unit ORDER BY b)), 1) AS n FROM (SELECT DISTINCT plant, unit, b FROM {hourly})),
    mr{end} AS (SELECT x.*, n FROM {matrix} x JOIN nb{end} USING (plant, unit, b))"""


def split_runs_ctes(fraction: float, end: str = "") -> str:
    """``sr{end}``: runs marked as baseline; one across the border becomes two."""
    values = ", ".join(f"f{i}" for i in range(len(FIVE)))
    return f"""sp{end} AS (SELECT *, CAST(least(n, greatest(0, floor(al * {fraction}) - (e - n))) AS BIGINT) AS k FROM (SELECT *, sum(n) OVER (PARTITION BY plant, unit ORDER BY b) AS e, sum(n) OVER (PARTITION BY plant, unit) AS al FROM mr{end})),
    sr{end} AS (SELECT plant, unit, b AS time, k AS n, true AS is_base, {values} FROM sp{end} WHERE k > 0 UNION ALL SELECT plant, unit, b + INTERVAL 1 HOUR * k AS time, n - k AS n, false AS is_base, {values} FROM sp{end} WHERE n > k)"""
