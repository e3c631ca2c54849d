"""Aggregations: account cube, category sums, P&L lines, plan presence, the
five base figures (A1-A4, A12, A13).

All of them are one ``groupBy`` with conditional sums: Spark runs a partial
(map-side) aggregate before the shuffle, so a hot key (one entity holding a
third of the postings) is collapsed on every map task and never lands as raw
rows on one reducer. Report lines are then produced by a narrow ``inline`` of
one struct per P&L line over those sums: no join with the P&L structure, and
every line is present even when a category has no rows.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.structure import (CATEGORIES, LINE_HIGHER, LINE_KIND, LINE_ORDER,
                                   PNL_LINES, SIGN_MATRIX)

MONEY = "decimal(38,4)"
DIMENSIONS = ["period", "expense_type", "department", "cost_centre", "entity"]
MONEY_COLS = ["actual", "budget", "prior_year"]


def zero() -> Column:
    return F.lit(0).cast(MONEY)


def dsum(e: Column) -> Column:
    """Decimal sum that is 0 (not NULL) over no rows."""
    return F.coalesce(F.sum(e), zero()).cast(MONEY)


def present_dims(df: DataFrame) -> list[str]:
    return [c for c in DIMENSIONS if c in df.columns]


# ---------------------------------------------------------------------------
# A1 account cube
# ---------------------------------------------------------------------------

def account_cube(df: DataFrame) -> DataFrame:
    """Collapse postings to account x name x category x present dimensions,
    summing the money columns (NULL keys are kept as their own group)."""
    dims = present_dims(df)
    keys = ["account_code", "account_name", "category"] + dims
    if "period" in dims and "period_no" in df.columns:
        keys.append("period_no")
    for m in MONEY_COLS:
        if m not in df.columns:
            df = df.withColumn(m, zero())
    return df.groupBy(*keys).agg(*[dsum(F.col(m)).alias(m) for m in MONEY_COLS])


# ---------------------------------------------------------------------------
# Category sums and P&L lines (A2, A3)
# ---------------------------------------------------------------------------

def category_sums(df: DataFrame, by: Sequence[str], measures: dict[str, Column],
                  extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per ``by`` group with ``<measure>__<category>`` conditional
    sums for the four categories, plus any ``extra`` aggregates."""
    aggs = [dsum(F.when(F.col("category") == F.lit(c), e)).alias(f"{m}__{c}")
            for m, e in measures.items() for c in CATEGORIES]
    aggs += [e.alias(n) for n, e in (extra or {}).items()]
    return df.groupBy(*by).agg(*aggs)


def line_value(measure: str, label: str) -> Column:
    """Signed sum of the categories that make up a P&L line."""
    terms = [F.col(f"{measure}__{c}") * F.lit(s) for c, s in SIGN_MATRIX[label].items()]
    e = terms[0]
    for t in terms[1:]:
        e = e + t
    return e.cast(MONEY)


def lines_from_sums(sums: DataFrame, by: Sequence[str], measures: Sequence[str],
                    keep: Sequence[str] = ()) -> DataFrame:
    """Explode category sums to the seven P&L lines (narrow, no shuffle)."""
    structs = []
    for label, *_r in PNL_LINES:
        fields = [F.lit(LINE_ORDER[label]).alias("line_ord"), F.lit(label).alias("line"),
                  F.lit(LINE_KIND[label]).alias("kind"),
                  F.lit(LINE_HIGHER[label]).alias("higher_is_better")]
        fields += [line_value(m, label).alias(m) for m in measures]
        structs.append(F.struct(*fields))
    return sums.select(*by, *keep, F.inline(F.array(*structs)))


def pnl_lines(df: DataFrame, by: Sequence[str] = (),
              measures: dict[str, Column] | None = None,
              extra: dict[str, Column] | None = None) -> DataFrame:
    """A3: P&L lines per group; ``measures`` default to the three money
    columns."""
    measures = measures or {m: F.col(m) for m in MONEY_COLS}
    sums = category_sums(df, by, measures, extra)
    return lines_from_sums(sums, by, list(measures), keep=list(extra or {}))


def category_totals(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A2: totals per category (positive magnitudes)."""
    return (df.groupBy(*by, "category")
              .agg(*[dsum(F.col(m)).alias(m) for m in MONEY_COLS]))


# ---------------------------------------------------------------------------
# A4 plan presence
# ---------------------------------------------------------------------------

def budgeted_agg(budget: str = "budget") -> Column:
    """Aggregate expression: the group carries a plan (sum |budget| > 0)."""
    return F.coalesce(F.sum(F.abs(F.col(budget))), zero()) > 0


def has_budget(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(budgeted_agg().alias("has_budget"))


# ---------------------------------------------------------------------------
# A12 five base figures (plus prior year) in one pass
# ---------------------------------------------------------------------------

def horizon_measures(period_no, prefix: str = "") -> dict[str, Column]:
    """Conditional measures for the month (``period_no = p``), the year to
    date (``<= p``) and the full-year plan (no period criterion). The frame
    must already be one fiscal year."""
    p = F.lit(period_no) if isinstance(period_no, int) else period_no
    month = F.col("period_no") == p
    ytd = F.col("period_no") <= p
    return {
        f"{prefix}act": F.when(month, F.col("actual")),
        f"{prefix}bud": F.when(month, F.col("budget")),
        f"{prefix}py": F.when(month, F.col("prior_year")),
        f"{prefix}yact": F.when(ytd, F.col("actual")),
        f"{prefix}ybud": F.when(ytd, F.col("budget")),
        f"{prefix}ypy": F.when(ytd, F.col("prior_year")),
        f"{prefix}fybud": F.col("budget"),
    }


def five_figures(df: DataFrame, by: Sequence[str], period_no: int) -> DataFrame:
    """Month act/bud, YTD act/bud, full-year plan (and prior year) per
    group, one aggregate."""
    ms = horizon_measures(period_no)
    return df.groupBy(*by).agg(*[dsum(e).alias(n) for n, e in ms.items()])


def month_bit() -> Column:
    """The month of a row's period key as one bit of an int."""
    return F.call_function("shiftleft", F.lit(1), (F.col("period_no") % 100).cast("int"))


def months_elapsed_agg(period_no) -> Column:
    """P9 aggregate: distinct periods <= p with a nonzero actual, else the
    month number of p, else 1. The frame is one fiscal year, so the distinct
    months are the bits of one OR: no distinct aggregate, no expansion of rows."""
    p = F.lit(period_no) if isinstance(period_no, int) else period_no
    month = F.when((F.col("actual") != 0) & (F.col("period_no") <= p),
                   month_bit())
    posted = F.bit_count(F.coalesce(F.bit_or(month), F.lit(0)))
    fallback = F.coalesce((p % 100).cast("int"), F.lit(1))
    return F.when(posted > 0, posted).otherwise(fallback).cast("int")


def slice_history(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per slice and period, actual and budget sums."""
    return (df.groupBy(*by, "period", "period_no")
              .agg(dsum(F.col("actual")).alias("actual"),
                   dsum(F.col("budget")).alias("budget")))


def attach_group_aggregates(df: DataFrame, by: Sequence[str],
                            aggs: dict[str, Column]) -> DataFrame:
    """Attach per-group aggregates to every row of ``df`` without a window
    over an unpartitioned frame: aggregate (partial + final), then equi-join
    back on the group keys. With no keys the aggregate is exactly one row and
    is broadcast; with keys the side has one row per group and AQE picks the
    join from its measured size."""
    g = df.groupBy(*by).agg(*[e.alias(n) for n, e in aggs.items()])
    return join_on_keys(df, g, by)


def join_on_keys(df: DataFrame, one_per_key: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left join on ``by`` where NULL keys are equal (a NULL key is a group of
    its own, as in an aggregate); without keys the other side is one row."""
    if not by:
        return attach_scalar(df, one_per_key)
    right = one_per_key.select(*[F.col(k).alias(f"_k_{k}") for k in by],
                               *[c for c in one_per_key.columns if c not in by])
    cond = reduce(lambda x, y: x & y, [df[k].eqNullSafe(right[f"_k_{k}"]) for k in by])
    return df.join(right, cond, "left").drop(*[f"_k_{k}" for k in by])


def attach_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a global aggregate (exactly one row by
    construction) to every row: equi-join on a constant key with the one-row
    side broadcast."""
    k = "_one"
    return (df.withColumn(k, F.lit(1))
              .join(F.broadcast(one_row.withColumn(k, F.lit(1))), k).drop(k))
