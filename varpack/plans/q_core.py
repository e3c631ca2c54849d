"""Core queries: account cube, P&L lines, five figures, variance measures and
the management reports (A1-A4, A12, V1-V13, R1-R5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import measures as V
from ..functions.measures import Materiality
from ..functions.parse import period_key
from ..operators import aggregate as A
from ..operators import periods as PR
from ..operators import reports as R
from ..sources import fixture as X
from . import sqlgen as S
from .oracle_views import with_views
from .registry import register

FY, P = S.FY_YEAR, S.PERIOD
ACCT = ["account_code", "account_name", "category"]
CUBE_KEYS = ["account_code", "account_name", "category", "period", "expense_type",
             "department", "cost_centre", "entity", "period_no"]


def fy_frame(spark, sf_dir):
    return X.fiscal_year_frame(X.ledger(spark, sf_dir, fiscal_year=FY), FY)


def month_frame(spark, sf_dir, period_no=P):
    return X.ledger(spark, sf_dir, months=(period_no, period_no))


def _money_cols(df, cols=("actual", "budget", "prior_year")):
    return df.select(*[V.money(c).alias(c) if c in cols else F.col(c) for c in df.columns])


# ---------------------------------------------------------------------------
# A1-A4, A12
# ---------------------------------------------------------------------------

@register("a1_account_cube", with_views(
    f"SELECT {', '.join(CUBE_KEYS)}, {S.money('sum(actual)')} AS actual, "
    f"{S.money('sum(budget)')} AS budget, {S.money('sum(prior_year)')} AS prior_year "
    f"FROM ledger GROUP BY {', '.join(CUBE_KEYS)}", "ledger"))
def a1_account_cube(spark, sf_dir):
    return _money_cols(A.account_cube(X.ledger(spark, sf_dir)))


@register("a2_category_totals", with_views(
    f"SELECT period_no, category, {S.money('sum(actual)')} AS actual, "
    f"{S.money('sum(budget)')} AS budget, {S.money('sum(prior_year)')} AS prior_year "
    f"FROM ledger GROUP BY period_no, category", "ledger"))
def a2_category_totals(spark, sf_dir):
    return _money_cols(A.category_totals(X.ledger(spark, sf_dir), ["period_no"]))


@register("a3_pnl_lines", with_views(
    "WITH l AS (" + S.lines_sql("ledger", ["period_no"], {
        "actual": "actual", "budget": "budget", "prior_year": "prior_year"}) + ")\n"
    f"SELECT period_no, line_ord, line, {S.money('actual')} AS actual, "
    f"{S.money('budget')} AS budget, {S.money('prior_year')} AS prior_year FROM l",
    "ledger", extra=[S.signs_cte()]))
def a3_pnl_lines(spark, sf_dir):
    lines = A.pnl_lines(X.ledger(spark, sf_dir), ["period_no"])
    return lines.select("period_no", "line_ord", "line", V.money("actual").alias("actual"),
                        V.money("budget").alias("budget"),
                        V.money("prior_year").alias("prior_year"))


@register("a4_has_budget", with_views(
    "SELECT entity, period_no, coalesce(sum(abs(budget)), 0) > 0 AS has_budget FROM ledger "
    "GROUP BY entity, period_no UNION ALL "
    "SELECT '(actuals only)' AS entity, NULL AS period_no, false AS has_budget",
    "ledger"))
def a4_has_budget(spark, sf_dir):
    led = X.ledger(spark, sf_dir)
    by_group = A.has_budget(led, ["entity", "period_no"])
    actuals_only = (A.has_budget(X.actuals_only(spark, sf_dir))
                    .select(F.lit("(actuals only)").alias("entity"),
                            F.lit(None).cast("int").alias("period_no"), "has_budget"))
    return by_group.unionByName(actuals_only)


FIVE = {"act": f"period_no = {P}", "bud": f"period_no = {P}", "py": f"period_no = {P}",
        "yact": f"period_no <= {P}", "ybud": f"period_no <= {P}", "ypy": f"period_no <= {P}",
        "fybud": None}
_SRC = {"act": "actual", "bud": "budget", "py": "prior_year", "yact": "actual",
        "ybud": "budget", "ypy": "prior_year", "fybud": "budget"}


def _five_sql(keys):
    cols = ", ".join(
        S.money(f"sum(CASE WHEN {c} THEN {_SRC[n]} ELSE 0 END)" if c else f"sum({_SRC[n]})")
        + f" AS {n}" for n, c in FIVE.items())
    return f"SELECT {', '.join(keys)}, {cols} FROM fy GROUP BY {', '.join(keys)}"


@register("a12_five_figures", with_views(_five_sql(ACCT + ["entity"]), "fy"))
def a12_five_figures(spark, sf_dir):
    f = A.five_figures(fy_frame(spark, sf_dir), ACCT + ["entity"], P)
    return f.select(*ACCT, "entity", *[V.money(n).alias(n) for n in FIVE])


@register("a13_slice_history", with_views(
    f"SELECT department, period, period_no, {S.money('sum(actual)')} AS actual, "
    f"{S.money('sum(budget)')} AS budget FROM ledger WHERE category <> 'Revenue' "
    "GROUP BY department, period, period_no", "ledger"))
def a13_slice_history(spark, sf_dir):
    spend = X.ledger(spark, sf_dir).filter(F.col("category") != "Revenue")
    h = A.slice_history(spend, ["department"])
    return h.select("department", "period", "period_no", V.money("actual").alias("actual"),
                    V.money("budget").alias("budget"))


# ---------------------------------------------------------------------------
# V1-V7, V9, V12 at account x period grain over the whole ledger
# ---------------------------------------------------------------------------

GRAIN = ACCT + ["period_no"]
_G = ", ".join(GRAIN)
_LEAF = (f"leaf AS (SELECT {_G}, sum(actual) AS actual, sum(budget) AS budget, "
         f"sum(prior_year) AS prior_year FROM ledger GROUP BY {_G})")


def _leaf(spark, sf_dir):
    return (X.ledger(spark, sf_dir).groupBy(*GRAIN)
            .agg(*[A.dsum(F.col(m)).alias(m) for m in ("actual", "budget", "prior_year")]))


@register("v1_variance", with_views(
    f"SELECT {_G}, {S.money('actual - budget')} AS var_bud, "
    f"{S.money('actual - prior_year')} AS var_py FROM leaf", "ledger", extra=[_LEAF]))
def v1_variance(spark, sf_dir):
    return _leaf(spark, sf_dir).select(
        *GRAIN, V.money(V.variance("actual", "budget")).alias("var_bud"),
        V.money(V.variance("actual", "prior_year")).alias("var_py"))


@register("v2_pct_nm", with_views(
    f"SELECT {_G}, {S.pct('actual - budget', 'budget')} AS var_bud_pct, "
    f"{S.pct('actual - prior_year', 'prior_year')} AS var_py_pct FROM leaf",
    "ledger", extra=[_LEAF]))
def v2_pct_nm(spark, sf_dir):
    return _leaf(spark, sf_dir).select(
        *GRAIN, V.pct_nm(V.variance("actual", "budget"), "budget").alias("var_bud_pct"),
        V.pct_nm(V.variance("actual", "prior_year"), "prior_year").alias("var_py_pct"))


@register("v3_fav_unfav", with_views(
    f"SELECT {_G}, {S.fu('(actual - budget)', "(category = 'Revenue')")} AS fav_unfav FROM leaf",
    "ledger", extra=[_LEAF]))
def v3_fav_unfav(spark, sf_dir):
    return _leaf(spark, sf_dir).select(
        *GRAIN, V.favourable(V.variance("actual", "budget"),
                             V.higher_is_better_for_category("category")).alias("fav_unfav"))


@register("v4_material", with_views(
    f"SELECT {_G}, {S.material('(actual - budget)', S.pct('actual - budget', 'budget'))} "
    "AS material FROM leaf", "ledger", extra=[_LEAF]))
def v4_material(spark, sf_dir):
    var = V.variance("actual", "budget")
    return _leaf(spark, sf_dir).select(
        *GRAIN, V.material(var, V.pct_nm(var, "budget")).alias("material"))


def _acct_five_sql():
    return (f"f AS (SELECT {', '.join(ACCT)}, "
            f"sum(CASE WHEN period_no = {P} THEN actual ELSE 0 END) AS act, "
            f"sum(CASE WHEN period_no = {P} THEN budget ELSE 0 END) AS bud, "
            f"sum(CASE WHEN period_no <= {P} THEN actual ELSE 0 END) AS yact, "
            f"sum(CASE WHEN period_no <= {P} THEN budget ELSE 0 END) AS ybud, "
            f"sum(budget) AS fybud FROM fy GROUP BY {', '.join(ACCT)})")


MONTHS_SQL = (f"mo AS (SELECT CAST(count(DISTINCT period_no) AS INT) AS months FROM fy "
              f"WHERE actual <> 0 AND period_no <= {P})")


def _acct_five(spark, sf_dir):
    fy = fy_frame(spark, sf_dir)
    return A.five_figures(fy, ACCT, P), fy


@register("v5_flag", with_views(
    "SELECT " + ", ".join(ACCT) + ", "
    + S.material("(act - bud)", S.pct("act - bud", "bud")) + " AS month_material, "
    + S.material("(yact - ybud)", S.pct("yact - ybud", "ybud")) + " AS ytd_material, "
    + S.flag(S.material("(act - bud)", S.pct("act - bud", "bud")),
             S.material("(yact - ybud)", S.pct("yact - ybud", "ybud"))) + " AS flag FROM f",
    "fy", extra=[_acct_five_sql()]))
def v5_flag(spark, sf_dir):
    f, _ = _acct_five(spark, sf_dir)
    mv, yv = V.variance("act", "bud"), V.variance("yact", "ybud")
    mm = V.material(mv, V.pct_nm(mv, "bud"))
    ym = V.material(yv, V.pct_nm(yv, "ybud"))
    return f.select(*ACCT, mm.alias("month_material"), ym.alias("ytd_material"),
                    V.flag(mm, ym).alias("flag"))


def _months_col(fy):
    """P9 over one fiscal year at posting grain, as a one-row frame."""
    return fy.agg(A.months_elapsed_agg(P).alias("months"))


@register("v6_run_rate", with_views(
    "SELECT " + ", ".join(f"f.{c}" for c in ACCT) + ", mo.months, "
    "CASE WHEN mo.months <> 0 THEN CAST(f.yact AS DOUBLE) * 12.0 / CAST(mo.months AS DOUBLE) END "
    "AS run_rate FROM f CROSS JOIN mo", "fy", extra=[_acct_five_sql(), MONTHS_SQL]))
def v6_run_rate(spark, sf_dir):
    f, fy = _acct_five(spark, sf_dir)
    j = A.attach_scalar(f, _months_col(fy))
    return j.select(*ACCT, "months", V.run_rate(V.dbl("yact"), F.col("months").cast("double"))
                    .alias("run_rate"))


@register("v7_var_to_fy", with_views(
    "WITH r AS (SELECT f.*, CAST(f.yact AS DOUBLE) * 12.0 / CAST(mo.months AS DOUBLE) AS rr "
    "FROM f CROSS JOIN mo) SELECT " + ", ".join(ACCT) + ", "
    "rr - CAST(fybud AS DOUBLE) AS fy_var, " + S.pct("(rr - CAST(fybud AS DOUBLE))", "fybud")
    + " AS fy_pct, " + S.money("yact + (fybud - ybud)") + " AS plan_for_rest FROM r",
    "fy", extra=[_acct_five_sql(), MONTHS_SQL]))
def v7_var_to_fy(spark, sf_dir):
    f, fy = _acct_five(spark, sf_dir)
    j = A.attach_scalar(f, _months_col(fy))
    rr = V.run_rate(V.dbl("yact"), F.col("months").cast("double"))
    fyv = rr - V.dbl("fybud")
    return j.select(*ACCT, fyv.alias("fy_var"), V.pct_nm(fyv, "fybud").alias("fy_pct"),
                    V.money(F.col("yact") + (F.col("fybud") - F.col("ybud"))).alias("plan_for_rest"))


# ---------------------------------------------------------------------------
# R1-R5 and the plan-gate / lever variants of the flagship
# ---------------------------------------------------------------------------

R2_SQL = with_views(S.pnl_full_sql("cube", []), "fy", extra=[S.CUBE, S.signs_cte()])


@register("r2_pnl_full", R2_SQL)
def r2_pnl_full(spark, sf_dir):
    return R.pnl_full(fy_frame(spark, sf_dir), P)


@register("r2_pnl_by_entity", with_views(S.pnl_full_sql("cube", ["entity"]), "fy",
                                         extra=[S.CUBE, S.signs_cte()]))
def r2_pnl_by_entity(spark, sf_dir):
    return R.pnl_full(fy_frame(spark, sf_dir), P, by=["entity"])


_ALL_KEYS = "entity, period_no"
_ALL = [
    # every (entity, period) meets the rows of its fiscal year, as the report of one period does
    "pe AS (SELECT DISTINCT entity, period_no FROM ledger)",
    "jr AS (SELECT pe.entity, pe.period_no, l.category, sum(CASE WHEN l.period_no = pe.period_no THEN actual ELSE 0 END) AS act, "
    "sum(CASE WHEN l.period_no = pe.period_no THEN budget ELSE 0 END) AS bud, sum(CASE WHEN l.period_no <= pe.period_no THEN actual ELSE 0 END) AS yact, "
    "sum(CASE WHEN l.period_no <= pe.period_no THEN budget ELSE 0 END) AS ybud, sum(budget) AS fybud FROM pe JOIN (SELECT entity, period_no, category, "
    "sum(actual) AS actual, sum(budget) AS budget FROM ledger GROUP BY ALL) l ON l.entity = pe.entity AND l.period_no // 100 = pe.period_no // 100 GROUP BY ALL)",
    "cx AS (SELECT pe.entity, pe.period_no, sum(l.b) > 0 AS budgeted, CAST(CASE WHEN count(*) FILTER (WHERE l.p <= pe.period_no AND posted) > 0 "
    "THEN count(*) FILTER (WHERE l.p <= pe.period_no AND posted) ELSE pe.period_no % 100 END AS INT) AS months_elapsed FROM pe JOIN (SELECT entity, period_no AS p, "
    "sum(abs(budget)) AS b, bool_or(actual <> 0) AS posted FROM ledger GROUP BY entity, period_no) l ON l.entity = pe.entity AND l.p // 100 = pe.period_no // 100 GROUP BY pe.entity, pe.period_no)",
    "ln AS (SELECT pe.entity, pe.period_no, s.line_ord, s.line, s.kind, s.hib, " + ", ".join(f"sum(s.sign * coalesce(jr.{c}, 0)) AS {c}" for c in ("act", "bud", "yact", "ybud", "fybud"))
    + " FROM pe CROSS JOIN signs s LEFT JOIN jr ON jr.entity = pe.entity AND jr.period_no = pe.period_no AND jr.category = s.category GROUP BY ALL)"]


@register("r2_pnl_by_entity_period", with_views(
    "SELECT ln.entity, ln.period_no, line_ord, line, kind, months_elapsed, " + S.tail_sql("ln", "ln.hib", "cx.budgeted", "cx.months_elapsed")
    + " FROM ln JOIN cx ON cx.entity = ln.entity AND cx.period_no = ln.period_no", "ledger", extra=[S.signs_cte(), *_ALL]))
def r2_pnl_by_entity_period(spark, sf_dir):
    """The full P&L of every entity at every period, in one job."""
    return R.pnl_all_periods(X.ledger(spark, sf_dir), ["entity"])


@register("r2_pnl_latest", with_views(
    "SELECT ln.entity, ln.period_no, line_ord, line, kind, months_elapsed, " + S.tail_sql("ln", "ln.hib", "cx.budgeted", "cx.months_elapsed")
    + " FROM ln JOIN cx ON cx.entity = ln.entity AND cx.period_no = ln.period_no JOIN (SELECT entity, max(period_no) FILTER (WHERE actual <> 0) AS p FROM ledger "
    "GROUP BY entity) rp ON rp.entity = ln.entity AND rp.p = ln.period_no", "ledger", extra=[S.signs_cte(), *_ALL]))
def r2_pnl_latest(spark, sf_dir):
    """The full P&L of every entity at its own reporting period."""
    led = X.ledger(spark, sf_dir)
    at = PR.reporting_period(led, ["entity"]).select("entity", period_key("reporting_period").alias("period_no"))
    return R.pnl_all_periods(led, ["entity"]).join(at, ["entity", "period_no"])


def listing_sql(source: str) -> str:
    keys = "period, period_no, account_code, account_name, category, expense_type, department, cost_centre, entity"
    return with_views(f"SELECT {keys}, " + ", ".join(f"{S.money(f'sum({m})')} AS {m}" for m in ("actual", "budget", "prior_year"))
                      + f" FROM {source} GROUP BY {keys}", source)


@register("s6_gl_listing", listing_sql("ledger"))
def s6_gl_listing(spark, sf_dir):
    return R.gl_listing(X.ledger(spark, sf_dir))


@register("r1_pnl_month", with_views(
    S.build_report_sql("m", []), "ledger",
    extra=[f"m AS (SELECT * FROM ledger WHERE period_no = {P})", S.signs_cte()]))
def r1_pnl_month(spark, sf_dir):
    return R.build_report(month_frame(spark, sf_dir))


@register("r1_pnl_by_entity_period", with_views(
    S.build_report_sql("ledger", ["entity", "period_no"]), "ledger", extra=[S.signs_cte()]))
def r1_pnl_by_entity_period(spark, sf_dir):
    return R.build_report(X.ledger(spark, sf_dir), by=["entity", "period_no"])


@register("r3_leaf", with_views(
    "WITH x AS (SELECT account_code, account_name, category, sum(actual) AS actual, "
    "sum(budget) AS budget, sum(prior_year) AS prior_year FROM m "
    "GROUP BY account_code, account_name, category), "
    "b AS (SELECT coalesce(sum(abs(budget)), 0) > 0 AS budgeted FROM x) "
    "SELECT account_code, account_name, category, " + S.money("actual") + " AS actual, "
    + S.money("budget") + " AS budget, " + S.money("prior_year") + " AS prior_year, "
    "CASE WHEN budgeted THEN " + S.money("actual - budget") + " END AS var_bud, "
    "CASE WHEN budgeted THEN " + S.pct("actual - budget", "budget") + " END AS var_bud_pct, "
    "CASE WHEN budgeted THEN " + S.fu("(actual - budget)", "(category = 'Revenue')")
    + " ELSE '' END AS fav_unfav, coalesce(budgeted AND "
    + S.material("(actual - budget)", S.pct("actual - budget", "budget"))
    + ", false) AS material FROM x CROSS JOIN b", "ledger",
    extra=[f"m AS (SELECT * FROM ledger WHERE period_no = {P})"]))
def r3_leaf(spark, sf_dir):
    return R.by_size(R.leaf_variances(month_frame(spark, sf_dir)))


@register("r4_kpi", with_views(
    "SELECT line_ord, line, ytd_actual, ytd_pct, actual, var_bud_pct FROM ("
    + S.pnl_full_sql("cube", []) + ") r "
    "WHERE line IN ('Revenue', 'Operating income (EBIT)', 'Net income')",
    "fy", extra=[S.CUBE, S.signs_cte()]))
def r4_kpi(spark, sf_dir):
    return R.kpi_cards(fy_frame(spark, sf_dir), P)


@register("r5_prior_year", with_views(
    "SELECT period_no, line_ord, line, actual, prior_year, var_py, var_py_pct FROM ("
    + S.build_report_sql("ledger", ["period_no"]) + ") r", "ledger", extra=[S.signs_cte()]))
def r5_prior_year(spark, sf_dir):
    return R.prior_year_report(X.ledger(spark, sf_dir), ["period_no"])


@register("v9_no_plan", with_views(
    S.pnl_full_sql("cube", []), "fy",
    extra=[S.CUBE.replace("sum(budget) AS budget", "sum(0) AS budget"), S.signs_cte()]))
def v9_no_plan(spark, sf_dir):
    return R.pnl_full(X.actuals_only(spark, sf_dir, FY), P)


@register("v12_levers", with_views(
    S.pnl_full_sql("cube", [], abs_floor=10000.0, pct_floor=0.05, months=4), "fy",
    extra=[S.CUBE, S.signs_cte()]))
def v12_levers(spark, sf_dir):
    return R.pnl_full(fy_frame(spark, sf_dir), P, rule=Materiality(10000.0, 0.05), months=4)
