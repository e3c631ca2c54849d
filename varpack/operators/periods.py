"""Period selection and frame filters."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.structure import EXPENSE_GROUPS, OTHER_EXPENSE_GROUP
from .aggregate import account_cube, attach_group_aggregates, attach_scalar, dsum

MULTIPLE = "(multiple)"


def periods_in(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct non-blank periods (with their key)."""
    p = F.trim(F.col("period"))
    return (df.filter(F.col("period").isNotNull() & (p != "") & (F.lower(p) != "nan"))
              .select(*by, p.alias("period"), "period_no").distinct())


def _order_key(prefix: str = "") -> Column:
    # unreadable labels (no key) sort after every readable one
    return F.struct(F.col("period_no").isNull().alias("unreadable"),
                    F.coalesce(F.col("period_no"), F.lit(0)).alias("key"),
                    F.trim(F.col("period")).alias("label"))


def reporting_period(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Latest period holding a nonzero actual, else the latest period."""
    blank = F.col("period").isNull() | (F.trim(F.col("period")) == "")
    d = df.filter(~blank)
    closed = F.max_by(F.when(F.col("actual") != 0, F.trim(F.col("period"))),
                      F.when(F.col("actual") != 0, _order_key()))
    latest = F.max_by(F.trim(F.col("period")), _order_key())
    return (d.groupBy(*by)
             .agg(F.coalesce(closed, latest).alias("reporting_period"),
                  F.count_distinct(F.trim(F.col("period"))).alias("n_periods")))


def filter_period(df: DataFrame, period: str, by: Sequence[str] = ()) -> DataFrame:
    """Keep one period; when no row of the frame (group) matches, the
    frame is returned unchanged. Without groups the test is a scalar subquery,
    evaluated once, so postings meet no join."""
    wanted = F.trim(F.col("period")) == F.lit(period)
    if not by:
        hits = df.filter(wanted).agg(F.count(F.lit(1))).scalar()
        return df.filter(wanted | (hits == 0))
    d = attach_group_aggregates(df, by, {"_hits": F.count_if(wanted)})
    return d.filter(wanted | (F.col("_hits") == 0)).drop("_hits")


def year_to_date(df: DataFrame, period_no: int) -> DataFrame:
    """Rows of the fiscal year up to ``period_no`` aggregated to account x
    dimensions without the period; empty when fewer than two periods."""
    fy0 = (period_no // 100) * 100
    upto = df.filter((F.col("period_no") > fy0) & (F.col("period_no") <= period_no))
    d = upto.drop("period", "period_no")
    cube = account_cube(d)
    n = upto.agg(F.count_distinct("period_no").alias("_n"))
    return attach_scalar(cube, n).filter(F.col("_n") >= 2).drop("_n")


def net_frame(df: DataFrame, cols: Sequence[str] = ("actual", "budget")) -> DataFrame:
    """Revenue x +1, everything else x -1."""
    sign = F.when(F.col("category") == "Revenue", F.lit(1)).otherwise(F.lit(-1))
    for c in cols:
        df = df.withColumn(c, F.col(c) * sign)
    return df


ALL_DIMS = ("period", "expense_type", "department", "cost_centre", "entity")


def present_aggs(df: DataFrame, dims: Sequence[str] = ALL_DIMS, suffix: str = "") -> list[Column]:
    """P7 as aggregates: a dimension holds a nonblank value other than '(multiple)'."""
    aggs = []
    for d in dims:
        v = F.trim(F.col(d).cast("string")) if d in df.columns else F.lit(None).cast("string")
        aggs.append(F.coalesce(F.bool_or(v.isNotNull() & (v != "") & (v != MULTIPLE)), F.lit(False)).alias(d + suffix))
    return aggs


def dims_present(df: DataFrame, by: Sequence[str] = (), dims: Sequence[str] = ALL_DIMS) -> DataFrame:
    """Which dimensions are present, in one aggregate."""
    return df.groupBy(*by).agg(*present_aggs(df, dims))


def expense_group_table(spark) -> DataFrame:
    """Fixed 17-row table (group_ord, expense_group, type_ord, expense_type)."""
    rows = [(gi + 1, g, ti + 1, t) for gi, (g, ts) in enumerate(EXPENSE_GROUPS)
            for ti, t in enumerate(ts)]
    return spark.createDataFrame(
        rows, "group_ord int, expense_group string, type_ord int, expense_type string")


def with_expense_group(df: DataFrame) -> DataFrame:
    """Attach the expense group (broadcast of the fixed table); unknown
    types go to 'Other expense types', ordered last and by name."""
    g = F.broadcast(expense_group_table(df.sparkSession))
    j = df.join(g, "expense_type", "left")
    return (j.withColumn("group_ord", F.coalesce(F.col("group_ord"), F.lit(len(EXPENSE_GROUPS) + 1)))
             .withColumn("expense_group", F.coalesce(F.col("expense_group"),
                                                     F.lit(OTHER_EXPENSE_GROUP))))


def months_elapsed(df: DataFrame, period_no: int, by: Sequence[str] = ()) -> DataFrame:
    """P9 per group."""
    from .aggregate import months_elapsed_agg
    return df.groupBy(*by).agg(months_elapsed_agg(period_no).alias("months_elapsed"))


def ytd_all_periods(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Month and year-to-date figures at every period at once.

    Aggregate to (slice, period) first (partial aggregation collapses hot
    slices), then a running sum over (slice, fiscal year) ordered by period:
    each window partition holds at most twelve rows."""
    per = (df.withColumn("fiscal_year", (F.col("period_no") / 100).cast("int"))
             .groupBy(*by, "fiscal_year", "period_no")
             .agg(dsum(F.col("actual")).alias("actual"), dsum(F.col("budget")).alias("budget")))
    w = (Window.partitionBy(*by, "fiscal_year").orderBy("period_no")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (per.withColumn("ytd_actual", F.sum("actual").over(w))
               .withColumn("ytd_budget", F.sum("budget").over(w)))


def union_periods(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of period frames by column name; a column that a frame lacks
    is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
