"""Deck analytics (D1-D6): figures derived from the full P&L (R2), the leaf
variances (R3) and the roll-ups - every one a projection or a small
aggregate over already-aggregated rows."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import measures as V
from ..functions.structure import CATEGORIES
from .aggregate import dsum, horizon_measures
from .periods import present_aggs
from .reports import leaf_variances, pnl_full

# Fixed values (must equal the reference).
WORSE_RATIO = 1.15
BETTER_RATIO = 0.85
DIVERGENCE_FLOOR = 1000.0
OUTLOOK_LINES = ["Revenue", "Gross profit", "Operating income (EBIT)", "Net income"]


def typical_month(fy: DataFrame, period_no: int, by: Sequence[str] = ()) -> DataFrame:
    """Month variance against the average month (YTD variance / months)
    per line; the verdict compares their magnitudes."""
    r = pnl_full(fy, period_no, by)
    avg = F.col("ytd_var") / F.col("months_elapsed").cast("double")
    ratio = F.when(avg != 0, F.col("var_bud") / avg)
    verdict = (F.when(F.abs(F.col("var_bud")) > F.abs(avg) * WORSE_RATIO, "worse")
                .when(F.abs(F.col("var_bud")) < F.abs(avg) * BETTER_RATIO, "better")
                .otherwise("in line"))
    return r.select(*by, "line_ord", "line", "var_bud", avg.alias("avg_month_var"),
                    ratio.alias("ratio"), verdict.alias("verdict"))


def divergence(fy: DataFrame, period_no: int, by: Sequence[str] = ()) -> DataFrame:
    """The category line whose month differs most from its average month
    (|month / average|, average at least 1000 in magnitude); of equal ratios
    the line that sorts last."""
    t = typical_month(fy, period_no, by).filter(
        F.col("line").isin("Revenue", "Cost of goods sold", "Operating expenses", "Other expenses")
        & (F.abs(F.col("avg_month_var")) >= DIVERGENCE_FLOOR))
    best = F.max(F.struct(F.abs(F.col("ratio")).alias("r"), "line"))
    return t.groupBy(*by).agg(best.alias("b")).filter("b IS NOT NULL").select(
        *by, F.col("b.line").alias("line"), F.col("b.r").alias("abs_ratio"))


def outlook(fy: DataFrame, period_no: int, by: Sequence[str] = ()) -> DataFrame:
    """D3: full-year plan, run rate and plan-for-the-rest (YTD actual plus the
    plan still to come), and the gap between the two paths."""
    r = pnl_full(fy, period_no, by).filter(F.col("line").isin(OUTLOOK_LINES))
    rest = F.col("ytd_actual") + (F.col("fy_budget") - F.col("ytd_budget"))
    return r.select(*by, "line_ord", "line", "fy_budget", "run_rate", rest.alias("plan_for_rest"),
                    (F.col("run_rate") - rest).alias("path_gap"))


def profit_bridge(frame: DataFrame) -> DataFrame:
    """D4 over the year to date (or one month where there is no more): all
    material accounts, netted: how far revenue falls short, how far cost is
    over, their effect on profit, the residual against the net-income variance
    and the largest mover."""
    leaves = leaf_variances(frame, rounded=False)
    rev, hit = F.col("category") == "Revenue", F.col("material")
    sign = F.when(rev, 1).otherwise(-1)
    agg = leaves.agg(
        dsum(F.when(hit & rev, -F.col("var_bud"))).alias("revenue_shortfall"),
        dsum(F.when(hit & ~rev, F.col("var_bud"))).alias("cost_overrun"),
        dsum(F.when(F.col("category").isin(*CATEGORIES), F.col("var_bud") * sign)).alias("ni_var"),
        F.max_by(F.when(hit, F.col("account_name")), F.when(hit, F.struct(F.abs(F.col("var_bud")), F.col("account_code"))))
         .alias("largest_mover"),
        F.count_if(hit).alias("n_material")).filter("n_material > 0")
    impact = -(F.col("revenue_shortfall") + F.col("cost_overrun"))
    return agg.select(V.money("revenue_shortfall").alias("revenue_shortfall"),
                      V.money("cost_overrun").alias("cost_overrun"), V.money(impact).alias("impact"),
                      V.money(F.col("ni_var") - impact).alias("residual"), "largest_mover", "n_material")


def spend_and_entities(fy: DataFrame, period_no: int) -> DataFrame:
    """Spend by department (YTD with the month) beside net income by
    entity, as one long table (view, key, ytd, month)."""
    ms = horizon_measures(period_no)
    spend = (fy.filter(F.col("category") != "Revenue").groupBy("department")
               .agg(dsum(ms["yact"]).alias("ytd"), dsum(ms["act"]).alias("month"))
               .select(F.lit("department_spend").alias("view"), F.col("department").alias("key"),
                       "ytd", "month"))
    sign = F.when(F.col("category") == "Revenue", 1).otherwise(-1)
    ent = (fy.groupBy("entity")
             .agg(dsum(F.when(F.col("period_no") <= period_no, F.col("actual") * sign)).alias("ytd"),
                  dsum(F.when(F.col("period_no") == period_no, F.col("actual") * sign)).alias("month"))
             .select(F.lit("entity_net_income").alias("view"), F.col("entity").alias("key"),
                     "ytd", "month"))
    u = spend.unionByName(ent)
    return u.select("view", "key", V.money("ytd").alias("ytd"), V.money("month").alias("month"))


def views_available(fy: DataFrame, period_no: int) -> DataFrame:
    """Which views the data supports: a plan, more than one period, a
    full-year plan, and each dimension. One pass, no distinct aggregate."""
    ms = horizon_measures(period_no)
    upto = F.when(F.col("period_no") <= period_no, F.col("period_no"))
    several = lambda e: F.coalesce(F.min(e) < F.max(e), F.lit(False))
    return fy.agg((F.coalesce(F.sum(F.abs("budget")), F.lit(0)) > 0).alias("has_plan"),
                  several(upto).alias("multi_period"),
                  (F.coalesce(F.sum(ms["fybud"]), F.lit(0)) != 0).alias("has_fy_plan"),
                  several(F.col("entity")).alias("entity_view"),
                  *present_aggs(fy, suffix="_present"))
