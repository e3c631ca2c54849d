"""Management reports (R1-R5) and the shared report tail.

Every report takes ``by`` keys, so one job produces the report for every
entity, period or other slice at once instead of looping over frames.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures as V
from ..functions.measures import Materiality
from ..functions.structure import CATEGORIES
from .aggregate import (MONEY, account_cube, attach_group_aggregates, budgeted_agg, category_sums, dsum, horizon_measures,
                        lines_from_sums, months_elapsed_agg)

# ---------------------------------------------------------------------------
# R1 build_report
# ---------------------------------------------------------------------------

def build_report(gl: DataFrame, by: Sequence[str] = (), rule: Materiality = Materiality(),
                 budgeted: bool | None = None, rounded: bool = True) -> DataFrame:
    """Management P&L: seven lines per group with budget and prior-year
    variances, F/U and materiality; plan-gated per group (V9)."""
    by = list(by)
    ms = {m: F.col(m) for m in ("actual", "budget", "prior_year")}
    extra = {"_budgeted": budgeted_agg()}
    lines = lines_from_sums(category_sums(gl, by, ms, extra), by, list(ms), keep=["_budgeted"])
    b = F.col("_budgeted") if budgeted is None else F.lit(bool(budgeted))
    var_bud = V.variance("actual", "budget")
    var_py = V.variance("actual", "prior_year")
    out = (lines
           .withColumn("_var_bud", var_bud)
           .withColumn("_pct_bud", V.pct_nm("_var_bud", "budget"))
           .withColumn("_var_py", var_py)
           .withColumn("_pct_py", V.pct_nm("_var_py", "prior_year")))
    money = V.money if rounded else V.col
    pct = V.pct_out if rounded else V.col
    return out.select(
        *by, "line_ord", "line", "kind",
        money("actual").alias("actual"),
        F.when(b, money("budget")).alias("budget"),
        money("prior_year").alias("prior_year"),
        F.when(b, money("_var_bud")).alias("var_bud"),
        F.when(b, pct("_pct_bud")).alias("var_bud_pct"),
        money("_var_py").alias("var_py"),
        pct("_pct_py").alias("var_py_pct"),
        F.when(b, V.favourable("_var_bud", F.col("higher_is_better"))).otherwise("")
         .alias("fav_unfav"),
        (b & V.material("_var_bud", "_pct_bud", rule)).alias("material"),
    )


def prior_year_report(gl: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The P&L against prior year (actuals only)."""
    r = build_report(gl, by)
    return r.select(*by, "line_ord", "line", "actual", "prior_year", "var_py", "var_py_pct")


# ---------------------------------------------------------------------------
# R2 full P&L: month, YTD, full year
# ---------------------------------------------------------------------------

def report_tail(df: DataFrame, higher: Column, rule: Materiality, budgeted: Column,
                months: Column) -> DataFrame:
    """V10 over columns act, bud, yact, ybud, fybud (decimal): the fourteen
    report columns. Subtotals (V11) call this after summing the base figures,
    so every percentage is re-derived, never added."""
    d = (df.withColumn("_var", V.variance("act", "bud"))
           .withColumn("_pct", V.pct_nm("_var", "bud"))
           .withColumn("_yvar", V.variance("yact", "ybud"))
           .withColumn("_ypct", V.pct_nm("_yvar", "ybud"))
           .withColumn("_rr", V.run_rate("yact", months))
           .withColumn("_fyvar", F.col("_rr") - V.dbl("fybud"))
           .withColumn("_fypct", V.pct_nm("_fyvar", "fybud"))
           .withColumn("_mmat", V.material("_var", "_pct", rule))
           .withColumn("_ymat", V.material("_yvar", "_ypct", rule)))
    g = budgeted
    return d.select(
        *[c for c in df.columns if c not in ("act", "bud", "yact", "ybud", "fybud", "py", "ypy")],
        V.money("act").alias("actual"),
        F.when(g, V.money("bud")).alias("budget"),
        F.when(g, V.money("_var")).alias("var_bud"),
        F.when(g, F.col("_pct")).alias("var_bud_pct"),
        V.money("yact").alias("ytd_actual"),
        F.when(g, V.money("ybud")).alias("ytd_budget"),
        F.when(g, V.money("_yvar")).alias("ytd_var"),
        F.when(g, F.col("_ypct")).alias("ytd_pct"),
        F.when(g, V.money("fybud")).alias("fy_budget"),
        F.col("_rr").alias("run_rate"),
        F.when(g, F.col("_fyvar")).alias("fy_var"),
        F.when(g, F.col("_fypct")).alias("fy_pct"),
        F.when(g, V.favourable("_var", higher)).alias("fav_unfav"),
        F.when(g, V.flag("_mmat", "_ymat")).alias("flag"),
    )


def pnl_full(fy: DataFrame, period_no: int, by: Sequence[str] = (),
             rule: Materiality = Materiality(), months: int | None = None) -> DataFrame:
    """R2 (flagship): the P&L with all horizons for reporting period
    ``period_no``; ``fy`` is one fiscal year of postings (or cube rows).

    Plan: postings -> account cube (partial + final hash aggregate, one
    shuffle) -> conditional sums per ``by`` group (second, tiny shuffle) ->
    narrow explode to lines."""
    by = list(by)
    cube = account_cube(fy)
    ms = horizon_measures(period_no)
    keep = {"_budgeted": budgeted_agg(),
            "months_elapsed": months_elapsed_agg(period_no) if months is None
            else F.lit(int(months))}
    base = ["act", "bud", "yact", "ybud", "fybud"]
    sums = category_sums(cube, by, {k: ms[k] for k in base}, keep)
    lines = lines_from_sums(sums, by, base, keep=list(keep))
    out = report_tail(lines, F.col("higher_is_better"), rule, F.col("_budgeted"),
                      F.col("months_elapsed"))
    return out.drop("_budgeted", "higher_is_better")


def pnl_all_periods(gl: DataFrame, by: Sequence[str] = (), rule: Materiality = Materiality()) -> DataFrame:
    """R2 for every group and every period of the ledger at once.

    Postings are summed once to (group, fiscal year, period, category). The year
    to date is a running sum over a fiscal year's periods and the full-year plan
    the sum over all of them: windows of at most twelve periods times four
    categories, whatever the ledger's size. Plan presence and months elapsed are
    those of the group's fiscal year up to the period, as in the report of one
    period."""
    by = list(by)
    year = [*by, "fiscal_year"]
    per = (gl.withColumn("fiscal_year", F.floor(F.col("period_no") / 100).cast("int"))
             .groupBy(*year, "period_no").agg(
                 *[dsum(F.when(F.col("category") == c, F.col(m))).alias(f"{k}__{c}")
                   for k, m in (("act", "actual"), ("bud", "budget")) for c in CATEGORIES],
                 F.sum(F.abs("budget")).alias("_plan"), F.max(F.when(F.col("actual") != 0, 1).otherwise(0)).alias("_posted")))
    upto = Window.partitionBy(*year).orderBy("period_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*year)
    d = per
    for c in CATEGORIES:
        d = (d.withColumn(f"yact__{c}", F.sum(f"act__{c}").over(upto).cast(MONEY))
              .withColumn(f"ybud__{c}", F.sum(f"bud__{c}").over(upto).cast(MONEY))
              .withColumn(f"fybud__{c}", F.sum(f"bud__{c}").over(whole).cast(MONEY)))
    months = F.sum("_posted").over(upto)
    d = (d.withColumn("_budgeted", F.coalesce(F.sum("_plan").over(whole), F.lit(0)) > 0)
          .withColumn("months_elapsed", F.when(months > 0, months).otherwise(F.col("period_no") % 100).cast("int")))
    base = ["act", "bud", "yact", "ybud", "fybud"]
    lines = lines_from_sums(d, [*by, "period_no"], base, keep=["_budgeted", "months_elapsed"])
    return report_tail(lines, F.col("higher_is_better"), rule, F.col("_budgeted"), F.col("months_elapsed")).drop("_budgeted", "higher_is_better")


def kpi_cards(fy: DataFrame, period_no: int, by: Sequence[str] = ()) -> DataFrame:
    """Revenue, EBIT and net income: YTD actual and %, month actual and %."""
    r = pnl_full(fy, period_no, by)
    return (r.filter(F.col("line").isin("Revenue", "Operating income (EBIT)", "Net income"))
             .select(*by, "line_ord", "line", "ytd_actual", "ytd_pct", "actual", "var_bud_pct"))


# ---------------------------------------------------------------------------
# R3 leaf variances
# ---------------------------------------------------------------------------

def leaf_variances(gl: DataFrame, by: Sequence[str] = (),
                   grain: Sequence[str] = ("account_code", "account_name", "category"),
                   rule: Materiality = Materiality(), budgeted: bool | None = None,
                   rounded: bool = True) -> DataFrame:
    """Variance per leaf (account) with F/U and materiality; plan-gated per
    ``by`` group. ``by_size`` puts the rows in report order."""
    by = list(by)
    keys = by + [g for g in grain if g not in by]
    leaves = gl.groupBy(*keys).agg(*[dsum(F.col(m)).alias(m)
                                    for m in ("actual", "budget", "prior_year")])
    if budgeted is None:
        leaves = attach_group_aggregates(leaves, by, {"_budgeted": budgeted_agg()})
    else:
        leaves = leaves.withColumn("_budgeted", F.lit(bool(budgeted)))
    b = F.col("_budgeted")
    d = (leaves.withColumn("_var", V.variance("actual", "budget"))
               .withColumn("_pct", V.pct_nm("_var", "budget")))
    mon = V.money if rounded else V.col
    return d.select(
        *keys,
        mon("actual").alias("actual"), mon("budget").alias("budget"),
        mon("prior_year").alias("prior_year"),
        F.when(b, mon("_var")).alias("var_bud"),
        F.when(b, F.col("_pct")).alias("var_bud_pct"),
        F.when(b, V.favourable("_var", V.higher_is_better_for_category("category")))
         .otherwise("").alias("fav_unfav"),
        (b & V.material("_var", "_pct", rule)).alias("material"),
    )


def by_size(leaves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Leaf rows in report order: groups, then |variance| descending, then code."""
    return leaves.orderBy(*by, F.abs(F.col("var_bud")).desc_nulls_last(), "account_code")


def gl_listing(gl: DataFrame) -> DataFrame:
    """The account-level ledger of the pack: the dimensions it has, money
    summed, in period and account order."""
    cube = account_cube(gl)
    keys = [c for c in ("period", "period_no", "account_code", "account_name", "category", "expense_type", "department", "cost_centre", "entity") if c in cube.columns]
    order = [c for c in ("period_no", "account_code", "department", "cost_centre", "entity") if c in keys]
    return cube.select(*keys, *[V.money(m).alias(m) for m in ("actual", "budget", "prior_year")]).orderBy(*order)
