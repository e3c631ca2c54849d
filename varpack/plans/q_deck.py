"""Queries for deck analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import deck as D
from . import sqlgen as S
from .oracle_views import with_views
from .q_core import P, fy_frame, month_frame
from .registry import register


_R2 = S.pnl_full_sql("cube", [])
_R2_EXTRA = [S.CUBE, S.signs_cte()]
_AVG = "(ytd_var / CAST(months_elapsed AS DOUBLE))"


@register("d1_typical_month", with_views(
    f"SELECT line_ord, line, var_bud, {_AVG} AS avg_month_var, "
    f"CASE WHEN {_AVG} <> 0 THEN var_bud / {_AVG} END AS ratio, "
    f"CASE WHEN abs(var_bud) > abs({_AVG}) * 1.15 THEN 'worse' "
    f"WHEN abs(var_bud) < abs({_AVG}) * 0.85 THEN 'better' ELSE 'in line' END AS verdict "
    f"FROM ({_R2}) r", "fy", extra=_R2_EXTRA))
def d1_typical_month(spark, sf_dir):
    return D.typical_month(fy_frame(spark, sf_dir), P)


@register("d2_divergence", with_views(
    f"SELECT line, abs_ratio FROM (SELECT line, abs(CASE WHEN {_AVG} <> 0 THEN var_bud / {_AVG} END) AS abs_ratio FROM ({_R2}) r "
    f"WHERE kind = 'category' AND abs({_AVG}) >= 1000) q ORDER BY abs_ratio DESC, line DESC LIMIT 1", "fy", extra=_R2_EXTRA))
def d2_divergence(spark, sf_dir):
    return D.divergence(fy_frame(spark, sf_dir), P)


@register("d3_outlook", with_views(
    "SELECT line_ord, line, fy_budget, run_rate, ytd_actual + (fy_budget - ytd_budget) AS plan_for_rest, "
    "run_rate - (ytd_actual + (fy_budget - ytd_budget)) AS path_gap "
    f"FROM ({_R2}) r WHERE line IN ('Revenue', 'Gross profit', 'Operating income (EBIT)', 'Net income')",
    "fy", extra=_R2_EXTRA))
def d3_outlook(spark, sf_dir):
    return D.outlook(fy_frame(spark, sf_dir), P)


def _bridge(where: str) -> list[str]:
    v = "(actual - budget)"
    return [f"ac AS (SELECT account_code, account_name, category, sum(actual) AS actual, sum(budget) AS budget FROM fy WHERE {where} "
            "GROUP BY account_code, account_name, category)",
            f"mt AS (SELECT *, {v} AS v FROM ac WHERE {S.material(v, S.pct(v, 'budget'))} AND (SELECT sum(abs(budget)) FROM ac) > 0)",
            "s AS (SELECT coalesce(-sum(v) FILTER (WHERE category = 'Revenue'), 0) AS short, coalesce(sum(v) FILTER (WHERE category <> 'Revenue'), 0) "
            "AS over, arg_max(account_name, (abs(v), account_code)) AS largest_mover, count(*) AS n_material FROM mt)",
            f"ni AS (SELECT sum(CASE WHEN category = 'Revenue' THEN {v} ELSE -{v} END) AS ni FROM ac)"]


def _bridge_sql(where: str) -> str:
    return with_views(
        f"SELECT {S.money('short')} AS revenue_shortfall, {S.money('over')} AS cost_overrun, {S.money('-(short + over)')} AS impact, "
        f"{S.money('ni + short + over')} AS residual, largest_mover, n_material FROM s CROSS JOIN ni WHERE n_material > 0", "fy", extra=_bridge(where))


@register("d4_bridge", _bridge_sql(f"period_no <= {P}"))
def d4_bridge(spark, sf_dir):
    return D.profit_bridge(fy_frame(spark, sf_dir).filter(F.col("period_no") <= P))


@register("d4_bridge_month", _bridge_sql(f"period_no = {P}"))
def d4_bridge_month(spark, sf_dir):
    return D.profit_bridge(month_frame(spark, sf_dir))


@register("d5_dept_entity", with_views(
    "SELECT 'department_spend' AS view, department AS key, "
    + S.money(f"sum(CASE WHEN period_no <= {P} THEN actual ELSE 0 END)") + " AS ytd, "
    + S.money(f"sum(CASE WHEN period_no = {P} THEN actual ELSE 0 END)") + " AS month "
    "FROM fy WHERE category <> 'Revenue' GROUP BY department UNION ALL "
    "SELECT 'entity_net_income', entity, "
    + S.money(f"sum(CASE WHEN period_no <= {P} THEN CASE WHEN category = 'Revenue' THEN actual ELSE -actual END ELSE 0 END)")
    + ", " + S.money(f"sum(CASE WHEN period_no = {P} THEN CASE WHEN category = 'Revenue' THEN actual ELSE -actual END ELSE 0 END)")
    + " FROM fy GROUP BY entity", "fy"))
def d5_dept_entity(spark, sf_dir):
    return D.spend_and_entities(fy_frame(spark, sf_dir), P)


def _present(c):
    v = f"trim(CAST({c} AS VARCHAR))"
    return f"coalesce(bool_or({v} IS NOT NULL AND {v} <> '' AND {v} <> '(multiple)'), false) AS {c}_present"


@register("d6_views_available", with_views(
    "SELECT coalesce(sum(abs(budget)), 0) > 0 AS has_plan, "
    f"count(DISTINCT CASE WHEN period_no <= {P} THEN period_no END) > 1 AS multi_period, "
    "coalesce(sum(budget), 0) <> 0 AS has_fy_plan, count(DISTINCT entity) > 1 AS entity_view, "
    + ", ".join(_present(c) for c in ("period", "expense_type", "department", "cost_centre", "entity"))
    + " FROM fy", "fy"))
def d6_views_available(spark, sf_dir):
    return D.views_available(fy_frame(spark, sf_dir), P)
