"""Queries for periods (P1-P9, W9, U1), roll-ups and pack views (A5-A11,
A14, A15, W4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import measures as V
from ..functions.structure import EXPENSE_GROUPS, OTHER_EXPENSE_GROUP
from ..operators import pack as PK
from ..operators import periods as PR
from ..operators import rollups as RU
from ..sources import fixture as X
from . import sqlgen as S
from .oracle_views import with_views
from .q_core import P, fy_frame, listing_sql, month_frame
from .registry import ORACLES, register

MONTH = f"m AS (SELECT * FROM ledger WHERE period_no = {P})"
TAIL_COLS = ["actual", "budget", "var_bud", "var_bud_pct", "ytd_actual", "ytd_budget",
             "ytd_var", "ytd_pct", "fy_budget", "run_rate", "fy_var", "fy_pct",
             "fav_unfav", "flag"]


def _groups_values() -> str:
    rows = ", ".join(f"({gi + 1}, '{g}', {ti + 1}, '{t}')" for gi, (g, ts) in
                     enumerate(EXPENSE_GROUPS) for ti, t in enumerate(ts))
    return f"eg(group_ord, expense_group, type_ord, expense_type) AS (VALUES {rows})"


# ---------------------------------------------------------------------------
# Periods
# ---------------------------------------------------------------------------

@register("p1_periods", with_views(
    "SELECT DISTINCT trim(period) AS period, period_no FROM ledger "
    "WHERE period IS NOT NULL AND trim(period) <> '' AND lower(trim(period)) <> 'nan'", "ledger"))
def p1_periods(spark, sf_dir):
    return PR.periods_in(X.ledger(spark, sf_dir))


@register("p2_reporting_period", with_views(
    "SELECT entity, coalesce(max_by(CASE WHEN actual <> 0 THEN trim(period) END, "
    "CASE WHEN actual <> 0 THEN period_no END), max_by(trim(period), period_no)) "
    "AS reporting_period, count(DISTINCT trim(period)) AS n_periods FROM ledger "
    "WHERE period IS NOT NULL AND trim(period) <> '' GROUP BY entity", "ledger"))
def p2_reporting_period(spark, sf_dir):
    return PR.reporting_period(X.ledger(spark, sf_dir), ["entity"])


@register("p3_month", with_views(
    "SELECT doc_no, line_no, account_code, entity, " + S.money("actual") + " AS actual FROM ledger "
    "WHERE trim(period) = '2000-06' OR (SELECT count(*) FROM ledger WHERE trim(period) = '2000-06') = 0",
    "ledger"))
def p3_month(spark, sf_dir):
    d = PR.filter_period(X.ledger(spark, sf_dir), "2000-06")
    return d.select("doc_no", "line_no", "account_code", "entity", V.money("actual").alias("actual"))


_YTD_KEYS = "account_code, account_name, category, expense_type, department, cost_centre, entity"


@register("p4_ytd", with_views(
    f"SELECT {_YTD_KEYS}, {S.money('sum(actual)')} AS actual, {S.money('sum(budget)')} AS budget, "
    f"{S.money('sum(prior_year)')} AS prior_year FROM ledger "
    f"WHERE period_no > 200000 AND period_no <= {P} GROUP BY {_YTD_KEYS}", "ledger"))
def p4_ytd(spark, sf_dir):
    y = PR.year_to_date(X.ledger(spark, sf_dir, months=(P // 100 * 100 + 1, P)), P)
    return y.select(*[c.strip() for c in _YTD_KEYS.split(",")],
                    *[V.money(m).alias(m) for m in ("actual", "budget", "prior_year")])


@register("p6_net_frame", with_views(
    "SELECT entity, period_no, "
    + S.money("sum(CASE WHEN category = 'Revenue' THEN actual ELSE -actual END)") + " AS net_actual, "
    + S.money("sum(CASE WHEN category = 'Revenue' THEN budget ELSE -budget END)") + " AS net_budget "
    "FROM ledger GROUP BY entity, period_no", "ledger"))
def p6_net_frame(spark, sf_dir):
    n = PR.net_frame(X.ledger(spark, sf_dir))
    return (n.groupBy("entity", "period_no")
             .agg(V.money(F.sum("actual")).alias("net_actual"),
                  V.money(F.sum("budget")).alias("net_budget")))


def _present_sql(c):
    v = f"trim(CAST({c} AS VARCHAR))"
    return f"coalesce(bool_or({v} IS NOT NULL AND {v} <> '' AND {v} <> '(multiple)'), false) AS {c}"


@register("p7_dims_present", with_views(
    "SELECT department, " + ", ".join(_present_sql(c) for c in
                                      ("period", "expense_type", "cost_centre", "entity"))
    + " FROM ledger GROUP BY department", "ledger"))
def p7_dims_present(spark, sf_dir):
    return PR.dims_present(X.ledger(spark, sf_dir), ["department"],
                           dims=("period", "expense_type", "cost_centre", "entity"))


@register("p8_expense_groups", with_views(
    f"SELECT DISTINCT l.expense_type, coalesce(eg.group_ord, {len(EXPENSE_GROUPS) + 1}) AS group_ord, "
    f"coalesce(eg.expense_group, '{OTHER_EXPENSE_GROUP}') AS expense_group, eg.type_ord "
    "FROM ledger l LEFT JOIN eg ON l.expense_type = eg.expense_type WHERE l.category <> 'Revenue'",
    "ledger", extra=[_groups_values()]))
def p8_expense_groups(spark, sf_dir):
    spend = X.ledger(spark, sf_dir).filter(F.col("category") != "Revenue").select("expense_type")
    return (PR.with_expense_group(spend.distinct())
              .select("expense_type", "group_ord", "expense_group", "type_ord"))


@register("p9_months_elapsed", with_views(
    f"SELECT entity, CAST(CASE WHEN count(DISTINCT CASE WHEN actual <> 0 AND period_no <= {P} "
    f"THEN period_no END) > 0 THEN count(DISTINCT CASE WHEN actual <> 0 AND period_no <= {P} "
    f"THEN period_no END) ELSE {P % 100} END AS INT) AS months_elapsed FROM fy GROUP BY entity", "fy"))
def p9_months_elapsed(spark, sf_dir):
    return PR.months_elapsed(fy_frame(spark, sf_dir), P, ["entity"])


@register("w9_ytd_all_periods", with_views(
    "WITH per AS (SELECT entity, CAST(period_no // 100 AS INT) AS fiscal_year, period_no, "
    "sum(actual) AS actual, sum(budget) AS budget FROM ledger GROUP BY entity, period_no // 100, period_no) "
    "SELECT entity, fiscal_year, period_no, " + S.money("actual") + " AS actual, "
    + S.money("budget") + " AS budget, "
    + S.money("sum(actual) OVER (PARTITION BY entity, fiscal_year ORDER BY period_no)") + " AS ytd_actual, "
    + S.money("sum(budget) OVER (PARTITION BY entity, fiscal_year ORDER BY period_no)") + " AS ytd_budget "
    "FROM per", "ledger"))
def w9_ytd_all_periods(spark, sf_dir):
    y = PR.ytd_all_periods(X.ledger(spark, sf_dir), ["entity"])
    return y.select("entity", "fiscal_year", "period_no",
                    *[V.money(c).alias(c) for c in ("actual", "budget", "ytd_actual", "ytd_budget")])


@register("u1_union_periods", with_views(
    "SELECT period_no, count(*) + count(DISTINCT (entity, department, account_code)) AS n_rows, "
    + S.money("sum(actual)") + " AS actual, " + S.money("sum(budget)") + " AS budget FROM ledger GROUP BY period_no", "ledger"))
def u1_union_periods(spark, sf_dir):
    """Actual postings and the plan, two extracts with different columns."""
    actuals = X.ledger(spark, sf_dir).select("period", "period_no", "entity", "account_code", "cost_centre", "actual")
    u = PR.union_periods([actuals, X.plan(spark, sf_dir)])
    return u.groupBy("period_no").agg(F.count(F.lit(1)).alias("n_rows"), V.money(F.sum("actual")).alias("actual"),
                                      V.money(F.sum("budget")).alias("budget"))


# ---------------------------------------------------------------------------
# Engine roll-ups on the month frame
# ---------------------------------------------------------------------------

def _spend_sql(key, extra_cols=""):
    v = "(actual - budget)"
    p = S.pct("actual - budget", "budget")
    return (f"SELECT {extra_cols}{key}, {S.money('actual')} AS actual, {S.money('budget')} AS budget, "
            f"{S.money('prior_year')} AS prior_year, {S.money(v)} AS var_bud, {p} AS var_bud_pct, "
            f"CASE WHEN {v} <= 0 THEN 'F' ELSE 'U' END AS fav_unfav, {S.material(v, p)} AS material "
            f"FROM g")


@register("a5_department", with_views(
    "WITH g AS (SELECT department, sum(actual) AS actual, sum(budget) AS budget, "
    "sum(prior_year) AS prior_year FROM m WHERE category <> 'Revenue' AND department IS NOT NULL "
    "GROUP BY department) " + _spend_sql("department"), "ledger", extra=[MONTH]))
def a5_department(spark, sf_dir):
    return RU.department_variances(month_frame(spark, sf_dir))


@register("a6_cost_centre", with_views(
    "WITH g AS (SELECT s.cost_centre, pd.department, sum(actual) AS actual, sum(budget) AS budget, "
    "sum(prior_year) AS prior_year FROM m s JOIN (SELECT cost_centre AS cc, min(department) AS department "
    "FROM m WHERE cost_centre IS NOT NULL GROUP BY cost_centre) pd ON s.cost_centre = pd.cc "
    "WHERE s.category <> 'Revenue' GROUP BY s.cost_centre, pd.department) "
    + _spend_sql("cost_centre", "department, "), "ledger", extra=[MONTH]))
def a6_cost_centre(spark, sf_dir):
    return RU.cost_centre_variances(month_frame(spark, sf_dir))


@register("a7_entity", with_views(
    "WITH g AS (SELECT entity, sum(CASE WHEN category = 'Revenue' THEN actual ELSE 0 END) AS ra, "
    "sum(CASE WHEN category = 'Revenue' THEN budget ELSE 0 END) AS rb, "
    "sum(CASE WHEN category <> 'Revenue' THEN actual ELSE 0 END) AS sa, "
    "sum(CASE WHEN category <> 'Revenue' THEN budget ELSE 0 END) AS sb FROM m "
    "WHERE entity IS NOT NULL GROUP BY entity) "
    "SELECT entity, " + S.money("ra") + " AS revenue, " + S.money("sa") + " AS spend, "
    + S.money("ra - sa") + " AS net_actual, " + S.money("rb - sb") + " AS net_budget, "
    + S.money("(ra - sa) - (rb - sb)") + " AS var_bud, " + S.pct("(ra - sa) - (rb - sb)", "(rb - sb)")
    + " AS var_bud_pct, CASE WHEN (ra - sa) - (rb - sb) >= 0 THEN 'F' ELSE 'U' END AS fav_unfav FROM g",
    "ledger", extra=[MONTH]))
def a7_entity(spark, sf_dir):
    return RU.entity_variances(month_frame(spark, sf_dir))


# ---------------------------------------------------------------------------
# Pack views with the month / YTD / full-year tail
# ---------------------------------------------------------------------------

_CTX = S.ctx_sql("fy")


def _tail_select(keys: str, hib: str = "false") -> str:
    return f"SELECT {keys}" + S.tail_sql("t", hib, "ctx.budgeted", "ctx.months") + " FROM t CROSS JOIN ctx"


@register("a8_expense_report", with_views(
    "WITH s AS (SELECT f.*, coalesce(eg.group_ord, 6) AS group_ord, "
    f"coalesce(eg.expense_group, '{OTHER_EXPENSE_GROUP}') AS expense_group, eg.type_ord "
    "FROM fy f LEFT JOIN eg ON f.expense_type = eg.expense_type WHERE f.category <> 'Revenue'), "
    "nt AS (SELECT group_ord, expense_group, count(DISTINCT coalesce(expense_type, '\x01')) AS n FROM s "
    "GROUP BY group_ord, expense_group), "
    "t AS (SELECT 'type' AS level, s.group_ord, s.expense_group, type_ord, expense_type, "
    + S.five_sums_sql() + " FROM s JOIN nt ON s.group_ord = nt.group_ord AND nt.n > 1 "
    "GROUP BY s.group_ord, s.expense_group, type_ord, expense_type "
    "UNION ALL SELECT 'group', group_ord, expense_group, NULL, NULL, " + S.five_sums_sql()
    + " FROM s GROUP BY group_ord, expense_group "
    "UNION ALL SELECT 'total', NULL, NULL, NULL, NULL, " + S.five_sums_sql() + " FROM s) "
    + _tail_select("level, group_ord, expense_group, type_ord, expense_type, "),
    "fy", extra=[_groups_values(), _CTX]))
def a8_expense_report(spark, sf_dir):
    return RU.expense_report(fy_frame(spark, sf_dir), P)


@register("a9_dept_cc_report", with_views(
    "WITH s AS (SELECT * FROM fy WHERE category <> 'Revenue' "
    "AND coalesce(department, '') NOT IN ('', '(multiple)')), "
    "t AS (SELECT 'cost_centre' AS level, department, coalesce(cost_centre, '') AS cost_centre, "
    + S.five_sums_sql() + " FROM s WHERE coalesce(cost_centre, '') NOT IN ('', '(multiple)') "
    "GROUP BY department, coalesce(cost_centre, '') "
    "UNION ALL SELECT 'department', department, NULL, " + S.five_sums_sql()
    + " FROM s GROUP BY department UNION ALL SELECT 'total', NULL, NULL, " + S.five_sums_sql()
    + " FROM s) " + _tail_select("level, department, cost_centre, "),
    "fy", extra=[_CTX]))
def a9_dept_cc_report(spark, sf_dir):
    return RU.department_report(fy_frame(spark, sf_dir), P)


_NET = ("n AS (SELECT period_no, entity, "
        "CASE WHEN category = 'Revenue' THEN actual ELSE -actual END AS actual, "
        "CASE WHEN category = 'Revenue' THEN budget ELSE -budget END AS budget FROM fy "
        "WHERE coalesce(entity, '') NOT IN ('', '(multiple)'))")


@register("a10_entity_report", with_views(
    "WITH t AS (SELECT 'entity' AS level, entity, " + S.five_sums_sql() + " FROM n GROUP BY entity "
    "UNION ALL SELECT 'total', NULL, " + S.five_sums_sql() + " FROM n) "
    + _tail_select("level, entity, ", "true") + " WHERE ctx.n_entities > 1",
    "fy", extra=[_NET, _CTX]))
def a10_entity_report(spark, sf_dir):
    return RU.entity_report(fy_frame(spark, sf_dir), P)


@register("a11_drivers", with_views(
    "WITH t AS (SELECT account_code, account_name, category, " + S.five_sums_sql()
    + " FROM fy GROUP BY account_code, account_name, category) "
    + _tail_select("account_code, account_name, category, ", "(t.category = 'Revenue')"),
    "fy", extra=[_CTX]))
def a11_drivers(spark, sf_dir):
    return RU.drivers(fy_frame(spark, sf_dir), P)


@register("w4_top_movers", with_views(
    "WITH x AS (SELECT account_code, account_name, category, sum(actual) AS actual, "
    "sum(budget) AS budget, sum(prior_year) AS prior_year FROM m "
    "GROUP BY account_code, account_name, category), "
    "b AS (SELECT coalesce(sum(abs(budget)), 0) > 0 AS budgeted FROM x), "
    "r AS (SELECT x.*, " + S.pct("actual - budget", "budget") + " AS p FROM x CROSS JOIN b "
    "WHERE b.budgeted AND " + S.material("(actual - budget)", S.pct("actual - budget", "budget")) + ") "
    "SELECT account_code, account_name, category, " + S.money("actual") + " AS actual, "
    + S.money("budget") + " AS budget, " + S.money("prior_year") + " AS prior_year, "
    + S.money("actual - budget") + " AS var_bud, p AS var_bud_pct, "
    + S.fu("(actual - budget)", "(category = 'Revenue')") + " AS fav_unfav, true AS material, "
    "CAST(row_number() OVER (ORDER BY abs(round(actual - budget, 2)) DESC, account_code) AS INT) AS rank "
    "FROM r QUALIFY rank <= 12", "ledger", extra=[MONTH]))
def w4_top_movers(spark, sf_dir):
    return RU.top_movers(month_frame(spark, sf_dir))


def _r(x):
    """full-precision total of a view"""
    return f"coalesce(sum({x}), 0)"


_A14 = (
    "WITH ent AS (SELECT entity, sum(CASE WHEN category = 'Revenue' THEN actual ELSE 0 END) AS ra, "
    "sum(CASE WHEN category <> 'Revenue' THEN actual ELSE 0 END) AS sa FROM m WHERE entity IS NOT NULL "
    "GROUP BY entity), "
    "cat AS (SELECT category, sum(actual) AS a FROM m GROUP BY category), "
    "pl AS (SELECT s.line, s.kind, sum(s.sign * coalesce(cat.a, 0)) AS a FROM signs s "
    "LEFT JOIN cat ON cat.category = s.category GROUP BY s.line, s.kind), "
    "dep AS (SELECT department, sum(actual) AS a FROM m WHERE category <> 'Revenue' "
    "AND department IS NOT NULL GROUP BY department), "
    "cc AS (SELECT cost_centre, sum(actual) AS a FROM m WHERE category <> 'Revenue' "
    "AND cost_centre IS NOT NULL GROUP BY cost_centre), "
    "acc AS (SELECT account_code, sum(actual) AS a FROM m GROUP BY account_code, account_name, category), "
    "v AS (SELECT "
    f"(SELECT {_r('ra - sa')} FROM ent) AS ent_ni, (SELECT {_r('ra')} FROM ent) AS ent_rev, "
    f"(SELECT {_r('ra')} - {_r('sa')} FROM ent) AS ent_rs, "
    f"(SELECT {_r('a')} FROM pl WHERE line = 'Net income') AS pl_ni, "
    f"(SELECT {_r('a')} FROM pl WHERE line = 'Revenue') AS pl_rev, "
    f"(SELECT {_r('a')} FROM pl WHERE kind = 'category' AND line <> 'Revenue') AS pl_spend, "
    f"(SELECT {_r('a')} FROM pl WHERE kind = 'category') AS pl_cat, "
    f"(SELECT {_r('a')} FROM dep) AS dep, (SELECT {_r('a')} FROM cc) AS cc, "
    "(SELECT coalesce(sum(actual), 0) FROM m WHERE category <> 'Revenue') AS ex, "
    f"(SELECT {_r('a')} FROM acc) AS acc, "
    "(SELECT coalesce(sum(actual), 0) FROM m) AS post) "
    "SELECT * FROM (VALUES "
    "('entity net income = P&L net income', (SELECT ent_ni FROM v), (SELECT pl_ni FROM v)), "
    "('entity revenue = P&L revenue', (SELECT ent_rev FROM v), (SELECT pl_rev FROM v)), "
    "('department spend = P&L spend', (SELECT dep FROM v), (SELECT pl_spend FROM v)), "
    "('cost-centre spend = P&L spend', (SELECT cc FROM v), (SELECT pl_spend FROM v)), "
    "('expense-type spend = P&L spend', (SELECT ex FROM v), (SELECT pl_spend FROM v)), "
    "('revenue - spend = net income', (SELECT ent_rs FROM v), (SELECT pl_ni FROM v)), "
    "('accounts = revenue + spend', (SELECT acc FROM v), (SELECT pl_cat FROM v)), "
    "('postings = P&L', (SELECT post FROM v), (SELECT pl_cat FROM v))) t(\"check\", lhs, rhs)")


@register("a14_reconcile", with_views(
    "SELECT \"check\", " + S.money("lhs") + " AS lhs, " + S.money("rhs") + " AS rhs, "
    "abs(lhs - rhs) <= 0.01 AS ok FROM (" + _A14 + ") q",
    "ledger", extra=[MONTH, S.signs_cte()]))
def a14_reconcile(spark, sf_dir):
    return RU.reconcile(month_frame(spark, sf_dir))


_ALL = {"entity net income = P&L net income": ("r - s", "r - s"), "entity revenue = P&L revenue": ("r", "r"), "department spend = P&L spend": ("s", "s"),
        "cost-centre spend = P&L spend": ("s", "s"), "expense-type spend = P&L spend": ("s", "s"), "revenue - spend = net income": ("r - s", "r - s"),
        "accounts = revenue + spend": ("t", "r + s"), "postings = P&L": ("t", "r + s")}


@register("a14_by_entity_period", with_views(
    " UNION ALL ".join(f"SELECT entity, period_no, '{check}' AS \"check\", {S.money(x)} AS lhs, {S.money(y)} AS rhs, true AS ok FROM g" for check, (x, y) in _ALL.items()),
    "ledger", extra=["g AS (SELECT entity, period_no, coalesce(sum(actual) FILTER (WHERE category = 'Revenue'), 0) AS r, "
                     "coalesce(sum(actual) FILTER (WHERE category <> 'Revenue'), 0) AS s, sum(actual) AS t FROM ledger GROUP BY entity, period_no)"]))
def a14_by_entity_period(spark, sf_dir):
    """The reconciliation of every entity in every period, from one pass."""
    return RU.reconcile(X.ledger(spark, sf_dir), by=["entity", "period_no"])


@register("a15_collapse_note", with_views(
    "SELECT (SELECT count(*) FROM ledger) AS rows_in, (SELECT count(*) FROM (SELECT DISTINCT "
    "account_code, account_name, category, period, expense_type, department, cost_centre, entity, "
    "period_no FROM ledger)) AS rows_out, (SELECT count(*) FROM ledger) - (SELECT count(*) FROM "
    "(SELECT DISTINCT account_code, account_name, category, period, expense_type, department, "
    "cost_centre, entity, period_no FROM ledger)) AS collapsed", "ledger"))
def a15_collapse_note(spark, sf_dir):
    return RU.collapse_note(X.ledger(spark, sf_dir))


_PACK = {"ledger": listing_sql("fy"), "pnl": ORACLES["r2_pnl_full"], "expense": ORACLES["a8_expense_report"], "entity": ORACLES["a10_entity_report"],
         "department": ORACLES["a9_dept_cc_report"], "drivers": ORACLES["a11_drivers"]}


@register("s5_pack_tables", " UNION ALL ".join(
    f"SELECT '{name}' AS \"table\", count(*) AS n_rows, round(sum(actual), 2) AS actual FROM ({sql}) {name}_t" for name, sql in _PACK.items()))
def s5_pack_tables(spark, sf_dir):
    """The pack's tables written from one cube, read back and counted."""
    return PK.read_pack(spark, PK.write_pack(fy_frame(spark, sf_dir), P))
