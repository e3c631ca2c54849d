"""Plan (budget) joins.

The plan is pre-aggregated on the join key before it meets the actuals.
Proportional allocation (J2) needs each key's total |actual| and line count:
an aggregate that is combined before the shuffle, joined with the plan to one
row per key. Lines then stream past that row, so a key that holds a third of
the ledger is a skewed join side, which adaptive execution splits, and never a
group that one task must hold. Plan keys without a line are appended.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parse import infer_category, period_key
from .aggregate import attach_scalar, dsum, join_on_keys

DIMS = ["period", "expense_type", "department", "cost_centre", "entity"]
TEXT = ["account_name", "category"]


def plan_keys(actuals: DataFrame, plan: DataFrame) -> list[str]:
    """account_code plus the dimensions both frames carry."""
    return ["account_code"] + [d for d in DIMS if d in actuals.columns and d in plan.columns]


def plan_amounts(plan: DataFrame) -> DataFrame:
    """A plan file that carries its amounts as ``actual`` (no budget at all,
    or none but zeros) has that column read as the budget."""
    if "actual" not in plan.columns:
        return plan
    if "budget" not in plan.columns:
        return plan.withColumnRenamed("actual", "budget")
    total = plan.agg(F.coalesce(F.sum(F.abs("budget")), F.lit(0)).alias("b"), F.coalesce(F.sum(F.abs("actual")), F.lit(0)).alias("a"))
    d = attach_scalar(plan, total)
    return d.withColumn("budget", F.when((F.col("b") == 0) & (F.col("a") > 0), F.col("actual")).otherwise(F.col("budget"))).drop("a", "b")


def budget_join(actuals: DataFrame, plan: DataFrame, allocate: bool = True) -> DataFrame:
    """Full outer join of actuals and the aggregated plan on the shared
    key (NULL keys equal), plan allocated in proportion to |actual| (evenly
    when the key has no actuals), plan-only rows filled. The allocated budget
    is a double: a share of a decimal has no fixed scale."""
    keys = plan_keys(actuals, plan)
    b = plan_amounts(plan).groupBy(*keys).agg(dsum(F.col("budget")).alias("budget"))
    a = actuals.drop("budget", "period_no")
    size = F.abs(F.coalesce(F.col("actual"), F.lit(0)))
    lines = a.groupBy(*keys).agg(F.sum(size).alias("_total"), F.count(F.lit(1)).alias("_n"))
    per_key = join_on_keys(b, lines, keys)
    out = join_on_keys(a, per_key, keys)
    if allocate:
        total, n = F.col("_total").cast("double"), F.col("_n").cast("double")
        share = F.when(total > 0, F.abs(F.col("actual")).cast("double") / total).otherwise(F.lit(1.0) / n)
        out = out.withColumn("budget", F.col("budget").cast("double") * share)
    out = out.drop("_total", "_n")
    alone = per_key.filter(F.col("_n").isNull()).drop("_total", "_n")
    if allocate:
        alone = alone.withColumn("budget", F.col("budget").cast("double"))
    return fill_plan_only(out.unionByName(alone, allowMissingColumns=True))


def fill_plan_only(df: DataFrame) -> DataFrame:
    """Money NULL -> 0, text NULL -> '', blank category -> code rule
    (K6), blank name -> the code; period key recomputed."""
    out = df
    for m in ("actual", "budget", "prior_year"):
        if m in out.columns:
            out = out.withColumn(m, F.coalesce(F.col(m), F.lit(0).cast(out.schema[m].dataType)))
    for c in TEXT + DIMS:
        if c in out.columns:
            t = F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
            out = out.withColumn(c, F.when(t.isin("nan", "None"), F.lit("")).otherwise(t))
    if "category" in out.columns:
        out = out.withColumn("category", F.when(F.col("category") == "",
                                                infer_category("account_code"))
                             .otherwise(F.col("category")))
    if "account_name" in out.columns:
        out = out.withColumn("account_name", F.when(F.col("account_name") == "",
                                                    F.col("account_code").cast("string"))
                             .otherwise(F.col("account_name")))
    if "period" in out.columns:
        out = out.withColumn("period_no", period_key("period"))
    return out


def plan_gap(actuals: DataFrame, plan: DataFrame) -> DataFrame:
    """Actual periods the plan does not cover."""
    a = actuals.select(F.trim("period").alias("period")).filter(F.col("period") != "").distinct()
    p = plan.select(F.trim("period").alias("period")).distinct()
    return a.join(p, "period", "left_anti")


def unmatched_counts(merged: DataFrame) -> DataFrame:
    """Lines budgeted with no actual, lines with actuals but no budget."""
    return merged.agg(F.count_if(F.col("actual") == 0).alias("budget_only_lines"),
                      F.count_if(F.col("budget") == 0).alias("actual_only_lines"))


def detail_outer(actuals: DataFrame, plan: DataFrame, keys: Sequence[str],
                 period_to: int | None = None, period_from: int | None = None) -> DataFrame:
    """Actual and plan each aggregated to ``keys`` over a period
    range, then full outer joined (USING keys) with missing sides as 0."""
    def rng(df):
        if period_from is not None:
            df = df.filter(F.col("period_no") >= period_from)
        if period_to is not None:
            df = df.filter(F.col("period_no") <= period_to)
        return df
    a = rng(actuals).groupBy(*keys).agg(dsum(F.col("actual")).alias("actual"))
    b = rng(plan).groupBy(*keys).agg(dsum(F.col("budget")).alias("budget"))
    j = a.join(b, list(keys), "full_outer")
    return j.select(*keys, F.coalesce("actual", F.lit(0)).alias("actual"),
                    F.coalesce("budget", F.lit(0)).alias("budget"))


def plan_left_actuals(plan: DataFrame, actuals: DataFrame, keys: Sequence[str],
                      period_no: int) -> DataFrame:
    """Plan lines of a month with that month's actuals (0 when none)."""
    b = plan.filter(F.col("period_no") == period_no).groupBy(*keys).agg(
        dsum(F.col("budget")).alias("budget"))
    a = actuals.filter(F.col("period_no") == period_no).groupBy(*keys).agg(
        dsum(F.col("actual")).alias("actual"))
    j = b.join(a, list(keys), "left")
    return j.select(*keys, "budget", F.coalesce("actual", F.lit(0)).alias("actual"))


def parent_lookup(df: DataFrame, child: str, parent: str) -> DataFrame:
    """One parent per child (the smallest seen; the reference takes
    the first seen, which has no meaning on a distributed frame)."""
    return (df.filter(F.col(child).isNotNull())
              .groupBy(child).agg(F.min(parent).alias(parent)))
