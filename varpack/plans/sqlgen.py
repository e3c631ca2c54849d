"""Small builders for the DuckDB oracle SQL.

The oracle is written the plain relational way - a VALUES sign matrix joined
to the rows and grouped by line - so it is an independent check of the Spark
side, which uses conditional sums and an explode instead.
"""

from __future__ import annotations

from ..functions.measures import DEFAULT_ABS_FLOOR, DEFAULT_PCT_FLOOR, NM_ABS_FLOOR, NM_RATIO_CAP
from ..functions.structure import sign_rows

FY_YEAR = 2000
PERIOD = 200006


def signs_cte() -> str:
    rows = ", ".join(f"({o}, '{l}', '{k}', {str(h).lower()}, '{c}', {s})"
                     for o, l, k, h, c, s in sign_rows())
    return f"signs(line_ord, line, kind, hib, category, sign) AS (VALUES {rows})"


def money(x: str) -> str:
    return f"CAST(round({x}, 2) AS DOUBLE)"


def pct(var: str, base: str) -> str:
    r = f"(CAST({var} AS DOUBLE) / abs(CAST({base} AS DOUBLE)))"
    return (f"(CASE WHEN {base} IS NULL OR abs({base}) < {NM_ABS_FLOOR} THEN NULL "
            f"WHEN abs{r} > {NM_RATIO_CAP} THEN NULL ELSE {r} END)")


def material(var: str, pct_expr: str, abs_floor: float = DEFAULT_ABS_FLOOR,
             pct_floor: float = DEFAULT_PCT_FLOOR) -> str:
    return (f"(abs({var}) >= {abs_floor} AND ({pct_expr} IS NULL "
            f"OR abs({pct_expr}) >= {pct_floor}))")


def fu(var: str, hib: str) -> str:
    return (f"(CASE WHEN (CASE WHEN {hib} THEN {var} >= 0 ELSE {var} <= 0 END) "
            f"THEN 'F' ELSE 'U' END)")


def flag(m: str, y: str) -> str:
    return (f"(CASE WHEN ({m}) AND ({y}) THEN 'BOTH' WHEN ({m}) THEN 'MONTH' "
            f"WHEN ({y}) THEN 'YTD' ELSE '' END)")


CUBE = """cube AS (SELECT account_code, account_name, category, period, expense_type, department,
  cost_centre, entity, period_no, sum(actual) AS actual, sum(budget) AS budget,
  sum(prior_year) AS prior_year
FROM fy GROUP BY account_code, account_name, category, period, expense_type, department,
  cost_centre, entity, period_no)"""


def _cat_agg(source: str, by: list[str], exprs: dict[str, str]) -> str:
    keys = ", ".join(by + ["category"])
    cols = ", ".join(f"sum({e}) AS {n}" for n, e in exprs.items())
    return f"SELECT {keys}, {cols} FROM {source} GROUP BY {keys}"


def lines_sql(source: str, by: list[str], exprs: dict[str, str]) -> str:
    """Relational P&L lines: groups x sign matrix, left join category sums."""
    agg = _cat_agg(source, by, exprs)
    on = " AND ".join([f"x.{k} = g.{k}" for k in by] + ["x.category = s.category"])
    gcols = ", ".join(f"g.{k}" for k in by)
    groups = (f"(SELECT DISTINCT {', '.join(by)} FROM {source}) g CROSS JOIN signs s"
              if by else "signs s")
    sums = ", ".join(f"sum(s.sign * coalesce(x.{n}, 0)) AS {n}" for n in exprs)
    gb = ", ".join(([gcols] if by else []) + ["s.line_ord", "s.line", "s.kind", "s.hib"])
    sel = ", ".join(([gcols] if by else []) + ["s.line_ord", "s.line", "s.kind", "s.hib"])
    return (f"SELECT {sel}, {sums} FROM {groups} LEFT JOIN ({agg}) x ON {on} GROUP BY {gb}")


def build_report_sql(source: str, by: list[str]) -> str:
    """Oracle for R1 over ``source`` (a CTE name) per ``by`` group."""
    lines = lines_sql(source, by, {"actual": "actual", "budget": "budget",
                                   "prior_year": "prior_year"})
    bgrp = (f"SELECT {', '.join(by)}, coalesce(sum(abs(budget)), 0) > 0 AS budgeted "
            f"FROM {source} GROUP BY {', '.join(by)}" if by else
            f"SELECT coalesce(sum(abs(budget)), 0) > 0 AS budgeted FROM {source}")
    join = (" JOIN b USING (" + ", ".join(by) + ")") if by else " CROSS JOIN b"
    vb, vp = "(l.actual - l.budget)", "(l.actual - l.prior_year)"
    pb, pp = pct(vb, "l.budget"), pct(vp, "l.prior_year")
    keys = "".join(f"l.{k}, " for k in by)
    return (f"WITH l AS ({lines}), b AS ({bgrp})\n"
            f"SELECT {keys}l.line_ord, l.line, l.kind, {money('l.actual')} AS actual, "
            f"CASE WHEN b.budgeted THEN {money('l.budget')} END AS budget, "
            f"{money('l.prior_year')} AS prior_year, "
            f"CASE WHEN b.budgeted THEN {money(vb)} END AS var_bud, "
            f"CASE WHEN b.budgeted THEN round({pb}, 4) END AS var_bud_pct, "
            f"{money(vp)} AS var_py, round({pp}, 4) AS var_py_pct, "
            f"CASE WHEN b.budgeted THEN {fu(vb, 'l.hib')} ELSE '' END AS fav_unfav, "
            f"coalesce(b.budgeted AND {material(vb, pb)}, false) AS material "
            f"FROM l{join}")


def pnl_full_sql(source: str, by: list[str], period: int = PERIOD,
                 abs_floor: float = DEFAULT_ABS_FLOOR, pct_floor: float = DEFAULT_PCT_FLOOR,
                 months: int | None = None) -> str:
    """Oracle for R2 over the cube CTE ``source`` (one fiscal year)."""
    ex = {"act": f"CASE WHEN period_no = {period} THEN actual ELSE 0 END",
          "bud": f"CASE WHEN period_no = {period} THEN budget ELSE 0 END",
          "yact": f"CASE WHEN period_no <= {period} THEN actual ELSE 0 END",
          "ybud": f"CASE WHEN period_no <= {period} THEN budget ELSE 0 END",
          "fybud": "budget"}
    lines = lines_sql(source, by, ex)
    gb = f" GROUP BY {', '.join(by)}" if by else ""
    sel = f"{', '.join(by)}, " if by else ""
    mexpr = (str(int(months)) if months is not None else
             f"CAST(CASE WHEN count(DISTINCT CASE WHEN actual <> 0 AND period_no <= {period} "
             f"THEN period_no END) > 0 THEN count(DISTINCT CASE WHEN actual <> 0 AND "
             f"period_no <= {period} THEN period_no END) ELSE {period % 100} END AS INT)")
    bgrp = (f"SELECT {sel}coalesce(sum(abs(budget)), 0) > 0 AS budgeted, {mexpr} AS months_elapsed "
            f"FROM {source}{gb}")
    join = (" JOIN b USING (" + ", ".join(by) + ")") if by else " CROSS JOIN b"
    keys = "".join(f"l.{k}, " for k in by)
    return (f"WITH l AS ({lines}), b AS ({bgrp})\n"
            f"SELECT {keys}l.line_ord, l.line, l.kind, b.months_elapsed, "
            + tail_sql("l", "l.hib", "b.budgeted", "b.months_elapsed", abs_floor, pct_floor)
            + f" FROM l{join}")


def tail_sql(t: str, hib: str, g: str, months: str, abs_floor: float = DEFAULT_ABS_FLOOR,
             pct_floor: float = DEFAULT_PCT_FLOOR) -> str:
    """The fourteen report columns (V10) over relation ``t`` holding act,
    bud, yact, ybud, fybud."""
    v, yv = f"({t}.act - {t}.bud)", f"({t}.yact - {t}.ybud)"
    p, yp = pct(v, f"{t}.bud"), pct(yv, f"{t}.ybud")
    rr = f"(CAST({t}.yact AS DOUBLE) * 12.0 / CAST({months} AS DOUBLE))"
    fyv = f"({rr} - CAST({t}.fybud AS DOUBLE))"
    fyp = pct(fyv, f"{t}.fybud")
    mm, ym = material(v, p, abs_floor, pct_floor), material(yv, yp, abs_floor, pct_floor)
    return (f"{money(t + '.act')} AS actual, CASE WHEN {g} THEN {money(t + '.bud')} END AS budget, "
            f"CASE WHEN {g} THEN {money(v)} END AS var_bud, CASE WHEN {g} THEN {p} END AS var_bud_pct, "
            f"{money(t + '.yact')} AS ytd_actual, CASE WHEN {g} THEN {money(t + '.ybud')} END AS ytd_budget, "
            f"CASE WHEN {g} THEN {money(yv)} END AS ytd_var, CASE WHEN {g} THEN {yp} END AS ytd_pct, "
            f"CASE WHEN {g} THEN {money(t + '.fybud')} END AS fy_budget, "
            f"CASE WHEN {months} <> 0 THEN {rr} END AS run_rate, "
            f"CASE WHEN {g} THEN {fyv} END AS fy_var, CASE WHEN {g} THEN {fyp} END AS fy_pct, "
            f"CASE WHEN {g} THEN {fu(v, hib)} END AS fav_unfav, "
            f"CASE WHEN {g} THEN {flag(mm, ym)} END AS flag")


def five_sums_sql(period: int = PERIOD) -> str:
    """The five base figures as SUM expressions over posting columns."""
    return (f"sum(CASE WHEN period_no = {period} THEN actual ELSE 0 END) AS act, "
            f"sum(CASE WHEN period_no = {period} THEN budget ELSE 0 END) AS bud, "
            f"sum(CASE WHEN period_no <= {period} THEN actual ELSE 0 END) AS yact, "
            f"sum(CASE WHEN period_no <= {period} THEN budget ELSE 0 END) AS ybud, "
            f"sum(budget) AS fybud")


def ctx_sql(source: str = "fy", period: int = PERIOD) -> str:
    """One-row context: plan presence and months elapsed over ``source``."""
    return (f"ctx AS (SELECT coalesce(sum(abs(budget)), 0) > 0 AS budgeted, "
            f"CAST(CASE WHEN count(DISTINCT CASE WHEN actual <> 0 AND period_no <= {period} "
            f"THEN period_no END) > 0 THEN count(DISTINCT CASE WHEN actual <> 0 AND "
            f"period_no <= {period} THEN period_no END) ELSE {period % 100} END AS INT) AS months, "
            f"count(DISTINCT entity) AS n_entities FROM {source})")

