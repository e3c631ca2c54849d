"""Roll-up views: department, cost centre, entity, expense report, drivers,
reconciliation (A5-A11, A14, A15, W4).

Every view sums the postings once, to the rows of its finest level; subtotals
are ``groupingSets`` over those few rows, so a subtotal adds the base figures
and re-derives percentages and flags (V11) instead of adding them.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures as V
from ..functions.measures import Materiality
from ..functions.structure import CATEGORIES, SIGN_MATRIX
from .aggregate import MONEY, attach_scalar, dsum, horizon_measures, month_bit, present_dims
from .periods import MULTIPLE, net_frame, with_expense_group
from .reports import report_tail

BASE = ["act", "bud", "yact", "ybud", "fybud"]


def leaf_frame(fy: DataFrame, keys: Sequence[str], period_no: int) -> DataFrame:
    """One row per ``keys``: the five figures and what the report context needs
    (plan size, months posted as bits, smallest and largest entity). The only
    pass over the postings; every level of a report comes from these rows."""
    p = F.lit(period_no)
    month = F.when((F.col("actual") != 0) & (F.col("period_no") <= p),
                   month_bit())
    return fy.groupBy(*keys).agg(
        *_base_aggs(period_no), F.sum(F.abs("budget")).alias("_plan"), F.bit_or(month).alias("_bits"),
        F.min("entity").alias("_first"), F.max("entity").alias("_last"))


def context_aggs(period_no: int) -> list[Column]:
    """Plan presence, months elapsed and whether there are several entities,
    over leaf rows."""
    posted = F.bit_count(F.coalesce(F.bit_or("_bits"), F.lit(0)))
    return [(F.coalesce(F.sum("_plan"), F.lit(0)) > 0).alias("_budgeted"),
            F.when(posted > 0, posted).otherwise(F.lit(period_no % 100 or 1)).cast("int").alias("_months"),
            (F.min("_first") < F.max("_last")).alias("_several")]


def _base_aggs(period_no: int) -> list[Column]:
    ms = horizon_measures(period_no)
    return [dsum(ms[k]).alias(k) for k in BASE]


def rolled(leaf: DataFrame, sets: Sequence[Sequence[str]], keys: Sequence[str], shown: Column, period_no: int) -> DataFrame:
    """Leaf rows at every level of ``sets`` (the last one is the total): the
    figures of the rows that are ``shown``, and on each row the context of all
    rows, which the total row knows. Levels without a shown row are dropped."""
    agg = leaf.groupingSets([list(x) for x in sets], *keys).agg(
        F.grouping_id().alias("_gid"), *[dsum(F.when(shown, F.col(k))).alias(k) for k in BASE],
        F.count_if(shown).alias("_shown"), *context_aggs(period_no))
    total = F.col("_gid") == 2 ** len(keys) - 1
    report = Window.partitionBy(F.lit(0))     # the rows of one report
    for c in ("_budgeted", "_months", "_several"):
        agg = agg.withColumn(c, F.max(F.when(total, F.col(c))).over(report))
    return agg.filter(F.col("_shown") > 0).drop("_shown")


def _tail(df: DataFrame, higher, rule: Materiality) -> DataFrame:
    hib = F.lit(higher) if isinstance(higher, bool) else higher
    out = report_tail(df, hib, rule, F.col("_budgeted"), F.col("_months"))
    return out.drop("_budgeted", "_months", "_several")


# ---------------------------------------------------------------------------
# Month-frame spend / entity variances (engine views A5-A7)
# ---------------------------------------------------------------------------

def _money_fn(rounded: bool):
    return V.money if rounded else (lambda c: V.col(c))


def _spend_cols(grp: DataFrame, keys: Sequence[str], rule: Materiality,
                rounded: bool = True) -> DataFrame:
    var = V.variance("actual", "budget")
    pct = V.pct_nm(var, "budget")
    money = _money_fn(rounded)
    return grp.select(*keys, money("actual").alias("actual"), money("budget").alias("budget"),
                      money("prior_year").alias("prior_year"), money(var).alias("var_bud"),
                      pct.alias("var_bud_pct"),
                      F.when(var <= 0, "F").otherwise("U").alias("fav_unfav"),
                      V.material(var, pct, rule).alias("material"))


def department_variances(detail: DataFrame, rule: Materiality = Materiality(),
                         level: str = "department", rounded: bool = True) -> DataFrame:
    """A5: spend (non-revenue) variance per department; F when var <= 0.
    NULL keys are dropped, '' is kept."""
    spend = detail.filter((F.col("category") != "Revenue") & F.col(level).isNotNull())
    grp = spend.groupBy(level).agg(*[dsum(F.col(m)).alias(m)
                                     for m in ("actual", "budget", "prior_year")])
    return _spend_cols(grp, [level], rule, rounded).orderBy(F.col("budget").desc(), F.col(level))


def cost_centre_variances(detail: DataFrame, rule: Materiality = Materiality(),
                          rounded: bool = True) -> DataFrame:
    """Spend variance per cost centre with its parent department (the
    smallest department seen with the cost centre), in one aggregate."""
    spend = F.coalesce(F.col("category") != "Revenue", F.lit(False))
    grp = (detail.filter(F.col("cost_centre").isNotNull()).groupBy("cost_centre")
           .agg(F.min("department").alias("department"), F.count_if(spend).alias("_n"),
                *[dsum(F.when(spend, F.col(m))).alias(m) for m in ("actual", "budget", "prior_year")])
           .filter(F.col("_n") > 0))
    return _spend_cols(grp, ["department", "cost_centre"], rule, rounded).orderBy(
        "department", F.col("budget").desc(), "cost_centre")


def entity_variances(detail: DataFrame, rounded: bool = True) -> DataFrame:
    """Net income per entity: revenue, spend, net actual and plan, F if
    var >= 0; ordered by revenue descending."""
    rev = F.col("category") == "Revenue"
    grp = (detail.filter(F.col("entity").isNotNull()).groupBy("entity")
           .agg(dsum(F.when(rev, F.col("actual"))).alias("rev_a"),
                dsum(F.when(rev, F.col("budget"))).alias("rev_b"),
                dsum(F.when(~rev, F.col("actual"))).alias("sp_a"),
                dsum(F.when(~rev, F.col("budget"))).alias("sp_b")))
    net_a = F.col("rev_a") - F.col("sp_a")
    net_b = F.col("rev_b") - F.col("sp_b")
    var = net_a - net_b
    money = _money_fn(rounded)
    return (grp.select("entity", money("rev_a").alias("revenue"), money("sp_a").alias("spend"),
                       money(net_a).alias("net_actual"), money(net_b).alias("net_budget"),
                       money(var).alias("var_bud"), V.pct_nm(var, net_b).alias("var_bud_pct"),
                       F.when(var >= 0, "F").otherwise("U").alias("fav_unfav"))
               .orderBy(F.col("revenue").desc(), "entity"))


# ---------------------------------------------------------------------------
# Pack views with month / YTD / full-year tail
# ---------------------------------------------------------------------------

def _is_spend() -> Column:
    return F.coalesce(F.col("category") != "Revenue", F.lit(False))


def expense_report(fy: DataFrame, period_no: int, rule: Materiality = Materiality()) -> DataFrame:
    """Expense types within groups, group subtotals and grand total; a
    group with one type shows only its subtotal row."""
    leaf = leaf_frame(fy.withColumn("_spend", _is_spend()), ["expense_type", "_spend"], period_no)
    keys = ["group_ord", "expense_group", "type_ord", "expense_type"]
    agg = rolled(with_expense_group(leaf), [keys, keys[:2], []], keys, F.col("_spend"), period_no)
    level = (F.when(F.col("_gid") == 0, "type").when(F.col("_gid") == 3, "group")
              .otherwise("total"))
    agg = agg.withColumn("level", level)
    w = Window.partitionBy("group_ord", "expense_group")
    n_types = F.sum(F.when(F.col("level") == "type", 1).otherwise(0)).over(w)
    agg = (agg.withColumn("_n_types", n_types)
              .filter(~((F.col("level") == "type") & (F.col("_n_types") == 1)))
              .drop("_gid", "_n_types"))
    return _tail(agg, False, rule)


def department_report(fy: DataFrame, period_no: int, rule: Materiality = Materiality()) -> DataFrame:
    """Department -> cost-centre spend report. Blank and '(multiple)'
    departments are not rows; a blank cost centre stays inside its
    department but is not shown as a leaf; the total adds departments."""
    named = ~F.coalesce(F.col("department"), F.lit("")).isin("", MULTIPLE)
    leaf = leaf_frame(fy.withColumn("cost_centre", F.coalesce(F.col("cost_centre"), F.lit("")))
                        .withColumn("_spend", _is_spend() & named), ["department", "cost_centre", "_spend"], period_no)
    keys = ["department", "cost_centre"]
    agg = rolled(leaf, [keys, keys[:1], []], keys, F.col("_spend"), period_no)
    level = (F.when(F.col("_gid") == 0, "cost_centre").when(F.col("_gid") == 1, "department")
              .otherwise("total"))
    agg = (agg.withColumn("level", level)
              .filter(~((F.col("level") == "cost_centre")
                        & F.col("cost_centre").isin("", MULTIPLE)))
              .drop("_gid"))
    return _tail(agg, False, rule)


def entity_report(fy: DataFrame, period_no: int, rule: Materiality = Materiality()) -> DataFrame:
    """A10: net income per entity plus the consolidated total; produced only
    when the frame holds more than one entity."""
    leaf = leaf_frame(net_frame(fy), ["entity"], period_no)
    named = ~F.coalesce(F.col("entity"), F.lit("")).isin("", MULTIPLE)
    agg = rolled(leaf, [["entity"], []], ["entity"], named, period_no)
    agg = (agg.withColumn("level", F.when(F.col("_gid") == 0, "entity").otherwise("total"))
              .filter(F.coalesce("_several", F.lit(False))).drop("_gid"))
    return _tail(agg, True, rule)


def drivers(fy: DataFrame, period_no: int, rule: Materiality = Materiality()) -> DataFrame:
    """One row per account of the fiscal year with the full tail,
    ordered by |month variance| descending, then code. The context is an
    aggregate of the same leaf rows: their exchange is reused."""
    leaf = leaf_frame(fy, ["account_code", "account_name", "category"], period_no)
    agg = attach_scalar(leaf.drop("_plan", "_bits", "_first", "_last"), leaf.agg(*context_aggs(period_no)))
    out = _tail(agg, V.higher_is_better_for_category("category"), rule)
    return out.orderBy(F.abs(F.col("var_bud")).desc_nulls_last(), "account_code")


def top_movers(month: DataFrame, k: int = 12, rule: Materiality = Materiality(),
               by: Sequence[str] = ()) -> DataFrame:
    """The k material accounts with the largest |variance| (per ``by``
    group); k is the chart's capacity, the limit is the feature."""
    from .reports import leaf_variances
    leaves = leaf_variances(month, by=by, rule=rule).filter(F.col("material"))
    w = Window.partitionBy(*by).orderBy(F.abs(F.col("var_bud")).desc(), F.col("account_code"))
    if by:
        return leaves.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    top = leaves.orderBy(F.abs(F.col("var_bud")).desc(), F.col("account_code")).limit(k)
    return top.withColumn("rank", F.row_number().over(w))


# ---------------------------------------------------------------------------
# A14 reconciliation, A15 collapse note
# ---------------------------------------------------------------------------

def reconcile(month: DataFrame, tolerance: float = 0.01, by: Sequence[str] = ()) -> DataFrame:
    """Every view's total against the P&L, as (check, lhs, rhs, ok), per
    ``by`` group (entities and periods, say).

    Postings are summed once to the finest grain any view has; the totals of
    the views (each with its own rule for blank keys) and of the P&L lines are
    then conditional sums over those rows, in one aggregate. Views are taken at
    full precision, so the tolerance tests the views, not display rounding."""
    keys = ["entity", "department", "cost_centre", "expense_type", "category", "account_code"]
    keys += [k for k in by if k not in keys]
    g = month.groupBy(*keys).agg(dsum(F.col("actual")).alias("a"))
    rev, spend = F.col("category") == "Revenue", F.col("category") != "Revenue"

    def total(*when: Column) -> Column:
        return dsum(F.when(reduce(lambda x, y: x & y, when, F.lit(True)), F.col("a")))

    category = {c: total(F.col("category") == c) for c in CATEGORIES}
    line = lambda label: reduce(lambda x, y: x + y, [category[c] * F.lit(s) for c, s in SIGN_MATRIX[label].items()])
    entity = F.col("entity").isNotNull()
    e_rev, e_spend = total(entity, rev), total(entity, spend)
    spend_lines = category["COGS"] + category["OpEx"] + category["Other"]
    every = category["Revenue"] + spend_lines
    checks = [
        ("entity net income = P&L net income", e_rev - e_spend, line("Net income")),
        ("entity revenue = P&L revenue", e_rev, line("Revenue")),
        ("department spend = P&L spend", total(spend, F.col("department").isNotNull()), spend_lines),
        ("cost-centre spend = P&L spend", total(spend, F.col("cost_centre").isNotNull()), spend_lines),
        ("expense-type spend = P&L spend", total(spend), spend_lines),
        ("revenue - spend = net income", e_rev - e_spend, line("Net income")),
        ("accounts = revenue + spend", total(), every),
        ("postings = P&L", total(), every),
    ]
    one = g.groupBy(*by).agg(F.array(*[F.struct(F.lit(n).alias("check"), x.cast(MONEY).alias("l"), y.cast(MONEY).alias("r"))
                          for n, x, y in checks]).alias("rows"))
    return one.select(*by, F.inline("rows")).select(
        *by, "check", V.money("l").alias("lhs"), V.money("r").alias("rhs"),
        (F.abs(F.col("l") - F.col("r")) <= F.lit(tolerance)).alias("ok"))


def collapse_note(postings: DataFrame) -> DataFrame:
    """Input rows before and after aggregation to the account cube."""
    keys = [c for c in ("account_code", "account_name", "category", *present_dims(postings), "period_no")
            if c in postings.columns]
    cube = postings.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return cube.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in"), F.count(F.lit(1)).alias("rows_out")).select(
        "rows_in", "rows_out", (F.col("rows_in") - F.col("rows_out")).alias("collapsed"))
